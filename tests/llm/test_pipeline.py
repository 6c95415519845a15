"""The pipeline against a brute-force version of its stages, and its contract."""

import hashlib
import re
from collections import defaultdict

from test_llm_operators import base_spans, brute_links

import corpus_pipeline
from quoin.llm import bpe_chunks, langid, secret_scan
from quoin.llm._base import table

SF = "/root/testdata/sf0.001"


def brute_redacted(text, ratios):
    n, spans = len(secret_scan.ALPHABET), [(a, b) for a, _, b in base_spans(text)]
    for m in re.finditer(secret_scan.CANDIDATE, text):
        at = [secret_scan.ALPHABET.find(c) for c in m[0]]
        total = sum(ratios[a * n + b] for a, b in zip(at, at[1:], strict=False))
        random = total >= 1000 * secret_scan.LEAST_RATIO and total >= 1000 * secret_scan.LEAST_MEAN * len(at)
        if random and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in spans):
            spans.append(m.span())
    merged = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = "", 0
    for a, b in merged:
        out, at = out + text[at:a] + "[secret]", b
    return out + text[at:]


def test_pipeline_is_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = langid.Scorer(langid.fit_language_model(docs))
    held = {d: t for d, t in held.items() if not score([t])[0][2]}
    held = {d: held[d] for d, (root, _) in brute_links(held).items() if root == d}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    where, sizes = defaultdict(set), {}
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        sizes[r["item_id"]] = len(w) - 7
        for k in range(len(w) - 7):
            where[tuple(w[k : k + 8])].add(r["item_id"])
    for d, t in list(held.items()):
        hits, w = defaultdict(set), words(t)
        for k in range(len(w) - 7):
            for i in where.get(tuple(w[k : k + 8]), ()):
                hits[i].add(tuple(w[k : k + 8]))
        if any(len(v) >= 0.4 * sizes[i] for i, v in hits.items()):
            del held[d]
    kept = spark.createDataFrame([(d, t) for d, t in held.items()], "doc_id long, text string")
    ratios = secret_scan.train_markov(kept)
    tok, want = Tokenizer.from_file(bpe_chunks.default_vocabulary()), {}
    for d, t in held.items():
        got = tok.encode(brute_redacted(t, ratios), add_special_tokens=False)
        want[d] = (len(got.ids), hashlib.sha256(" ".join(map(str, got.ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(got.ids, skip_special_tokens=False).encode()).hexdigest())
    out = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == want


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the and of to in is that", "en", "s", 24), (4, "der die und das nicht mit", "de", "s", 25), (4, "der die und das nicht mit", "de", "s", 25)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    clash = docs.selectExpr("*", "1 AS base", "2 AS added", "3 AS _runs", "4 AS _all", "5 AS _hex", "6 AS _row", "7 AS h", "8 AS node", "9 AS t", "10 AS near")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns
        assert {tuple(r)[5:] for r in got.collect()} <= {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}
    assert corpus_pipeline.STAGES[-1][1](spark, clash, SF).count() == len(rows)
