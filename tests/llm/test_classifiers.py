import random

from helpers import awkward, frame

from fenceline.llm import convnet, dictionaries


def corpus(n, seed=2):
    """Clean texts and texts with a marked kind of noise or abuse, alternating."""
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "in", "re", "st", "ou", "ha", "ti"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        bad = i % 2
        if bad:
            for k in rng.sample(range(len(words)), 6):
                words[k] = rng.choice(["vile", "rotten", "Scum!"])
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - bad, bad))
    return docs, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = corpus(400)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(1000 + k, t) for k, (_, t) in enumerate(awkward())] + [(None, "text")]
    for score, column in ((dictionaries.quality_scores, "quality"), (convnet.toxicity_scores, "toxic")):
        out = score(frame(spark, docs + extra), labels)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = out.collect()
        assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
        truth = {r["doc_id"]: r[column] for r in labels.collect()}
        held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
        assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add(r["score"])
        assert by_id[1003] == by_id[1046] == by_id[1047]  # equal texts, equal scores


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (dictionaries.quality_scores, convnet.toxicity_scores):
        assert score(frame(spark, []).limit(0), none).count() == 0
        assert score(frame(spark, [(1, "a"), (2, None)]), none).count() == 2


def test_maximum_stays_within_its_text():
    texts = [b"one two", b"three", b"", b"four five six seven"]
    h, bounds = convnet.hashes(texts)
    model = convnet.train(texts * 8, [1, 0, 0, 0] * 8)
    together = convnet.np.concatenate([model.score([t]) for t in texts])
    assert convnet.np.allclose(model.score(texts), together) and len(bounds) == 5 and len(h) == bounds[-1]
