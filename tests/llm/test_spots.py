import hashlib

from helpers import awkward, frame

from fenceline.llm import spots


def test_edited_text_and_likeness(spark):
    rows = awkward()
    out = spots.fingerprints(frame(spark, rows)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        want.append((repr(i), len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[9]["fingerprint"] == by_id[206]["fingerprint"] and by_id[200]["fingerprint"] == by_id[201]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def chains(text):
    import re

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in spots.ANCHORS:
            content = [x for x in words[i + 1 :] if x not in spots.ANCHORS][: spots.CHAIN]
            if len(content) == spots.CHAIN:
                found.add(tuple(content))
    return found or {tuple(words)}


def test_likeness_is_the_jaccard_of_chains(spark):
    texts = [t for _, t in awkward() if t and "\x00" not in t and len(t) < 1000]
    pairs = spark.createDataFrame(list(zip(texts, texts[1:])), "a string, b string")
    sets = pairs.select("a", "b", spots.signatures(pairs["a"]).alias("x"), spots.signatures(pairs["b"]).alias("y"))
    for r in sets.select("a", "b", spots.likeness(sets["x"], sets["y"]).alias("j")).collect():
        a, b = chains(r["a"]), chains(r["b"])
        assert abs(r["j"] - len(a & b) / len(a | b)) < 1e-9


def test_similar_pairs(spark):
    base = [f"the w{i} x{i} of y{i} z{i}" for i in range(30)]
    near = base[:29] + ["the other words of this"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, "the q r of s t"), (5, None), (6, "")]
    got = {(r["id_a"], r["id_b"]) for r in spots.similar(frame(spark, rows), 0.8).collect()}
    assert got == {(1, 2)}


def test_empty_and_single(spark):
    assert spots.fingerprints(frame(spark, []).limit(0)).count() == 0
    one = spots.fingerprints(frame(spark, [(7, "the cat sat")])).first()
    assert one["near_next"] == 1.0


def test_texts_without_fixed_anchors_keep_their_near_copies(spark):
    # Documents 1 and 2 are in a language that one more document of the table has; 4 follows with other words.
    text = " ".join(f"muž{i % 7} žena{i} dům" for i in range(40))
    english = " ".join(f"the cat{i} sat{i} on" for i in range(40))
    rows = [(1, text), (2, text + " konec"), (4, english), (5, " ".join(f"w{i}" for i in range(60))), (6, english)]
    by_id = {r["doc_id"]: r for r in spots.fingerprints(frame(spark, rows)).collect()}
    assert by_id[1]["near_next"] > 0.9
    assert by_id[1]["near_edited"] > 0.5 and by_id[2]["near_edited"] > 0.4
    # Numbered words that no other document has, edited with anchored words.
    assert by_id[5]["near_edited"] > 0.3


def test_long_runs_with_and_without_anchors_have_their_own_chains(spark):
    plain = " ".join(f"w{i}" for i in range(100))
    common = " ".join(["the of and to in is that it for on"] * 9 + ["der die das und von mit den dem ein eine"] * 3)
    rows = spark.createDataFrame([(plain, plain + " the x y"), (common, common + " x y")], "a string, b string")
    j = spots.likeness(spots.signatures(rows["a"]), spots.signatures(rows["b"]))
    assert all(r["j"] > 0.6 for r in rows.select(j.alias("j")).collect())


def test_anchors_are_the_most_common_words(spark):
    assert spots.common_words(frame(spark, [(1, "b a c"), (2, "A, b"), (3, "b d d"), (4, None)])) == ["b", "a"]
