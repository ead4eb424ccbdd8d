"""A hostile corpus: nulls, empty and very long texts, ties, repeated rows, near copies, clashing columns."""

import random

import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, lang_pred int, place int, row int, slice int, token int"


def hostile_rows():
    rng = random.Random(11)
    real = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in real]
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    own = [None, "", "   \n\t ", "one", "One", "two words", "TWO words", "a b c", "c b a", "ü É 汉字 , . ;", "x" * 300_000]
    own += [" ".join(f"w{rng.randrange(900)}" for _ in range(40_000)), " ".join(base), " ".join(base), " \n ".join(base).upper()]
    own += [edited(base, n) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 10, 15, 30) for _ in range(2)]
    own += ["word " * 500, "word " * 30, "tail 　 wide\x85space here", "emoji 😀 — “quotes” …", "<b>tags</b> & entities &amp; \x00 nul"]
    own += [rows[3][1] + " " + rows[7][1], rows[7][1], " ".join(rows[7][1].split()[:60]), "Ａｎｎａ full width", "1234567890 . , ! ?"]
    rows += [(10_000 + 7 * i, t, "en" if i % 3 else None, "hot" if i % 2 else None) for i, t in enumerate(own)]
    rows += [(None, "a text without an id, twice", None, ""), (None, "a text without an id, twice", None, ""), (10_000, "another text of an id that is taken", "de", "web")]
    rows += rows[5:8] + [(-5, rows[9][1], "en", "neg")]
    rng.shuffle(rows)
    return [(d, t, lang, s, None if t is None else len(t), "9", "9", 9, 9, 9, 9, 9) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return hostile_rows()


@pytest.fixture(scope="session")
def sf_dir(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hostile"))
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    items += [(900, None), (901, ""), (902, "two words"), (903, "word word word"), (904, "a B c"), (None, "one"), (905, rows[0][1] or "x"), (905, "TWO words"), (906, "汉字"), (907, "word " * 12)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()]
    spark.createDataFrame(labels + [(None, 1, 1), (10_007, None, None), labels[0]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def plain_toxicity():
    """A function of a model, a text and a threshold: the noisy-or of its sentences, and (number, sentence, chance) of those that reach the threshold; word by word."""
    import math
    import re

    import numpy as np

    from veilspark.llm import toxicity
    from veilspark.llm._words import ALNUM, words

    held = {}

    def weight(model, word):
        if word not in held.setdefault(id(model), {}):
            raw = np.frombuffer(word.encode(), np.uint8)
            w = words(raw, np.array([0, len(raw)]), ALNUM, True)
            held[id(model)][word] = sum(float(model.weights[f[0]]) for f in toxicity.features(raw, w, len(model.weights)).astype(int))
        return held[id(model)][word]

    def run(model, text, threshold=0.3):
        found, last = [], None
        for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            if last is None or re.search(r"[.!?\n]", text[last : m.start()]):
                found.append([m.start(), m.end(), model.bias])
            last = found[-1][1] = m.end()
            found[-1][2] += weight(model, m[0])
        clean, offending = 0.0, []
        for n, (a, z, logit) in enumerate(found or [(0, 0, model.bias)]):
            clean -= math.log1p(math.exp(min(logit, 700)))
            if found and (p := 1 / (1 + math.exp(-max(logit, -700)))) >= threshold:
                offending.append((n, text[a:z], p))
        return -math.expm1(clean), offending

    return run
