"""The statistics of the quality classifier text by text, long records of archives, and the pipeline on odd tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from touchline.llm import mixing, quality, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    if not words:
        return [0.0] * len(quality.STATISTICS)
    n = len(words)
    folded = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    counts = Counter(folded)
    solid = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]
    accents = sum(raw[i] == 0xC3 and 0x80 <= raw[i + 1] <= 0x9E for i in range(len(raw) - 1))
    upper = sum(65 <= b <= 90 for b in raw) + accents
    letters = max(1, upper + sum(97 <= b <= 122 for b in raw) + sum(b >= 0xC0 for b in raw))
    of = lambda chars: sum(b in chars for b in raw)
    return [
        math.log1p(n),
        math.log1p(sum(map(len, words)) / n),
        upper / letters,
        of(b"0123456789") / len(solid),
        of(b"#$%&*@^~<>{}[]\\/=+_") / len(solid),
        of(b"!") / n,
        of(b"|") / n,
        of(b".,;:?") / n,
        len(counts) / math.sqrt(n),
        max(counts.values()) / n,
        of(b"\n") / n,
        sum(w[-1] in b"#$%&*@^~<>{}[]\\/=+_!" for w in words) / n,
        sum(b >= 0xC0 for b in raw) / letters,
        math.log1p(max(map(len, words))),
        sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / n,
        of(b".") / n,
    ]


def odd_texts():
    rng = random.Random(9)
    parts = ["word", "Word", "WORD", "É", "été", "北京", "a|b", "x#", "ok!", "3.14", "é́", "\n", "\t\t", " ", "end.", "_", "ñandú?", "𝔸", "same", "same"]
    out = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    return out + [None, "", " \n", "one", "!", "same " * 5000, "É" * 70, "x" * 300_000]


def test_statistics_text_by_text(spark):
    texts = odd_texts()
    got = quality.statistics(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(text)), text
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, stats string").repartition(4)
    stats = {r.doc_id: r.stats for r in quality.document_statistics(docs).collect()}
    assert all(stats[i] == pytest.approx(plain_statistics(t)) for i, t in enumerate(texts))


def test_scores_of_statistics(spark):
    """A score is the calibrated sum of the weighted cosines of a text's own statistics; equal texts score alike."""
    texts = odd_texts() * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(len(t or "") % 2)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(quality.labelled(quality.document_statistics(docs), labels))
    scored = {r.doc_id: r.score for r in quality.score(quality.document_statistics(docs), model).collect()}
    half = len(texts) // 2
    for i, t in enumerate(texts):
        z = quality.fourier(np.array([plain_statistics(t)]), model.mean, model.scale)
        assert scored[i] == pytest.approx(float(np.interp(z @ model.weights, model.knots, model.values)[0]), abs=1e-6)
        assert scored[i] == pytest.approx(scored[(i + half) % len(texts)], abs=1e-12)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, s in scored.items() if s >= 0.5}


@pytest.mark.parametrize("split", [50_000, 1 << 20])
def test_records_longer_than_a_read(spark, split):
    rng = random.Random(1)
    pages = [(i, "".join(rng.choice("<p>ab é\n") for _ in range(n))) for i, n in enumerate((700_000, 10, 1_500_000, 300_000, 0))] + [(9, None)]
    manifest = warc.write_archives(spark.createDataFrame([(*p, f"http://x/{p[0]}") for p in pages], "page_id long, html string, url string"))
    got = {r.page_id: r for r in warc.read_archives(manifest, split).collect()}
    assert got.keys() == {p for p, _ in pages}
    for page, html in pages:
        data = (html or "").encode()
        assert got[page].payload_bytes == len(data)
        assert hashlib.sha1(data).digest() == base64.b32decode(got[page].payload_digest)


def test_mix_of_repeats_and_null_ids(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (None, None, None), (2, "f " * 50, "y"), (3, "", "y")]
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, source string, size int, rate string")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows) and all(0 <= r.copies <= 2 for r in plan)
    assert {r.source_size for r in plan} == {8, 50, 0}
    again = sorted(((r.doc_id or 0, r.size, r.copies) for r in mixing.mix_plan(docs.repartition(4)).collect()))
    assert again == sorted((r.doc_id or 0, r.size, r.copies) for r in plan)
    assert mixing.mix(docs).columns == docs.columns


def put(spark, folder, documents, labels, benchmark):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long, size string, rep long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for (name, kind), rows in zip(kinds.items(), (documents, labels, benchmark), strict=True):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path, [], [], [])).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated texts, tied ids and columns with clashing names go through all stages."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, same = prose(30), prose(60)
    texts = [prose(50) for _ in range(10)] + [same, same, same + " end", None, "", item, prose(20) + " " + item]
    rows = [(i, t, None, ["a", None][i % 2], None, "clash", 7) for i, t in enumerate(texts)] + [(0, texts[0], None, "a", 1, None, None), (None, prose(40), "xx", "b", 1, "c", 1)]
    got = corpus_pipeline.run(spark, put(spark, tmp_path, rows, [], [(1, item), (None, "x"), (2, None)])).collect()
    left = {r.doc_id for r in got}
    assert not {15, 16} & left and len({10, 11, 12} & left) <= 1 and left <= {*range(15), None}
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    copies = Counter(r.doc_id for r in got)
    assert max(copies.values()) <= 4  # twice for each of two rows of one id
