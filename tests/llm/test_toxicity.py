import random

from latticeworks.llm import toxicity


def test_folding():
    assert toxicity.fold("You ІDІ0T, tr4sh! m0r0n 42 1d10t $cum") == " you idiot trash moron 42 idiot cum "
    assert toxicity.fold("st@pid l!ar") == " stapid liar "
    assert toxicity.fold("") == "  " and toxicity.fold("...") == "  "


def test_exceptions_and_length():
    machine = toxicity.Lexicon({" trash ": 3.0, " tr": 1.0}).automaton()
    assert toxicity.features(machine, toxicity.fold("empty the trash can"))[0] == 0
    short, long = (toxicity.features(machine, toxicity.fold("trash " + "word " * n)) for n in (5, 500))
    assert short[0] == long[0] > 0 and short[1] > long[1]


def labelled(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [f"v{rng.randrange(300)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["zorgon", "z0rgon", "blikter"])
            w[rng.randrange(60)] = "grum" + rng.choice(["al", "ik", "os"]) + str(rng.choice(["a", "b"]))
        rows.append((i, " ".join(w), "en", "src", float(i)))
        labels.append((i, 0, int(bad)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "x", 0.0), (9001, "", "en", "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, f double"), spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    import zlib

    docs, labels = labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, lexicon).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scores[i] >= 0.5) == (i % 4 == 0) for i in held]
    assert sum(right) / len(right) > 0.95 and 0 <= scores[9000] < 0.5 and scores[9000] == scores[9001]
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.where("doc_id >= 9000").count() == 3


def test_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, none)
    assert toxicity.toxicity_scores(docs, lexicon).where("score >= 0.5").count() == 0
    assert toxicity.toxicity_scores(empty, lexicon).count() == 0
    bad = spark.createDataFrame([(1, "you pathetic worthless idiot")], "doc_id long, text string")
    assert toxicity.toxicity_scores(bad, lexicon).first()["score"] > 0.5
