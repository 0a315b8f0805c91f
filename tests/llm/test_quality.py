import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import quality

WORD = r"[^\x20\x09-\x0D]+"
GOOD = "the cat sat on a mat and then it went home to sleep for a while"
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "x\n\nx\nx \ny\ny", "\x1fa\x85b c　d #*$%&|<>", "é ü 日本\n日本\n日本 🙂",
    " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "a b " * 60, "z" * 3_000_000,
    "k l m\n" * 20_000, GOOD * 5, "\n", "a\n", "a\n\na", "a\r\na\r\n",
]


def counts(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def test_counts_agree_with_the_definitions(documents):
    rows = documents(*TEXTS, *TEXTS[3:6]).withColumns({"kept": F.lit("x"), "trusted": F.lit(1)})
    got = quality.quality_rules(rows, rows.where("doc_id = 13")).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        text = (TEXTS + TEXTS[3:6])[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text)
        assert not (r.base_failed and r.kept)


def test_ratio_is_that_of_the_two_multinomials(documents):
    clean = [" ".join(GOOD.split()[k:] + GOOD.split()[:k]) + f" n{k}" for k in range(12)] * 4
    junk = [" ".join(w + "!!" for w in text.upper().split()) for text in clean]
    texts = [t + " " + " ".join(f"u{i}q{j}" for j in range(50)) for i, t in enumerate(clean + junk)]
    rows = documents(*texts)
    trusted = rows.where("doc_id < 24")
    got = {r.doc_id: r for r in quality.quality_rules(rows, trusted, threshold=0.0).collect()}
    assert min(got[i].log_ratio for i in range(48)) > max(got[i].log_ratio for i in range(48, 96))
    assert got[0].kept and not got[60].kept
    counts = quality.bucket_counts(rows.withColumn("trusted", F.col("doc_id") < 24))
    weights = quality.bucket_weights(counts)
    pieces = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", t) for t in texts]
    assert counts[0].sum() == sum(2 * len(p) - 1 for p in pieces)
    assert counts[1].sum() == sum(2 * len(p) - 1 for p in pieces[:24])
    assert weights[counts[0] == 0] == pytest.approx(weights[counts[0] == 0][0])


def test_no_trusted_document_and_empty_table(documents, spark):
    rows = documents(GOOD * 5)
    none = rows.where("false")
    assert quality.quality_rules(rows, none).first().log_ratio == pytest.approx(0)
    assert quality.quality_rules(none, none).count() == 0
