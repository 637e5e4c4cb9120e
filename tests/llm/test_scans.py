"""Long runs and many matches: the codec on runs of signs, the secret scan against a plain version of all its spans."""

import math
import random
import re
import string
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import piece_codec, queries, secret_scan


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_runs_of_signs(sp):
    codec = piece_codec.codec(queries.piece_model())
    for c in [*string.punctuation, " ", "▁", "—", "é", "日", "\U0001f600", "\n"]:
        for text in (c * 3000, f"x\n{c * 1500}\ny", f"word{c * 1200} word{c}"):
            assert codec.encode(text)[0] == sp.encode(text, add_eos=True), (c, len(text))
    assert codec.encode("=" * 1_000_000)[0] == sp.encode("=" * 1_000_000, add_eos=True)


def test_mixed_runs_of_signs(sp):
    codec, rng = piece_codec.codec(queries.piece_model()), random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("=-_.,!?#*\"'()/ ") * rng.choice((1, 1, 2, 3, 4, 60)) if rng.random() < 0.7 else rng.choice(("word", "Der", "x1")) for _ in range(rng.randint(1, 25)))
        assert codec.encode(text)[0] == sp.encode(text, add_eos=True), text


def test_run_of_signs_in_a_table(spark, sp):
    text = "x\n" + "=" * 1500 + "\ny"
    got = piece_codec.encode_decode(spark.createDataFrame([(1, text), (2, "-" * 5000)], "doc_id long, text string"), queries.piece_model())
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {1: len(sp.encode(text, add_eos=True)), 2: len(sp.encode("-" * 5000, add_eos=True))}


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    """Base spans, and runs of key characters with a window of high entropy, by windows counted one by one."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        run = m[0]
        if len(run) < 20 or any(re.search(p, run) for p in secret_scan.ALLOWED):
            continue
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", run) else 3.8 if re.fullmatch("[A-Za-z0-9]+", run) else 4.0
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(run[i : i + 20]).values()) for i in range(len(run) - 19))
        if abs(best - least) < 1e-9:
            continue
        if best >= least:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain_redacted(text, spans):
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_all_spans_and_redaction(spark):
    rng = random.Random(8)
    letters = string.ascii_letters
    parts = ["token = ", "PASSWORD: ", "AKIA", "ABCDEFGH12345678", "deadbeef", "é", "\U0001f600", " ", "\n", "=", "https://x.org/a/b/", "documentation/of/paths/", "-" * 25, "example", "x" * 30]
    key = lambda: "".join(rng.choice(rng.choice((letters, letters + string.digits, string.hexdigits, secret_scan.ALPHABET))) for _ in range(rng.randint(15, 50)))
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else key() for _ in range(rng.randint(0, 20))) for _ in range(600)]
    texts += ["", "é" * 5000 + " token=abcdef1 " + "日" * 3000 + " token=abcdef2", "a" * 1024 + " token=abcdef1", "token=abcdef1" + " " * 1023]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.scan(docs).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans")))
    for r in found.collect():
        spans = [(s["start"], s["kind"], s["end"]) for s in r["spans"]]
        assert spans == plain_spans(r["text"]), r["text"]
        assert r["clean"] == plain_redacted(r["text"], spans)


def test_letters_only_key_is_found(spark):
    rng = random.Random(1)
    key = "".join(rng.choice(string.ascii_letters) for _ in range(32))
    got = secret_scan.scan(spark.createDataFrame([(1, f"the key {key} here")], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in got["spans"]] == [(8, 40)]


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = "\n".join(f"token=abcdef{k}" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("_scanned", F.lit(1)).withColumn("scanned", F.lit(2))
    row = secret_scan.scan(docs).select(F.size("base_spans").alias("n"), F.element_at("base_spans", -1)["end"].alias("last"), "_scanned", "scanned").first()
    assert tuple(row) == (n, len(text), 1, 2)
