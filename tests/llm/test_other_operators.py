"""Scoring, search, archives, fingerprints, chat and the pipeline against brute force, with odd rows."""

import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import chat, langid, maxent, queries, toxicity, vafile, warc, weighted
from sparkloom.llm.common import held_out, table

from .test_text_operators import ODD, brute_components, docs_of, thue_morse, words_of


def test_maxent_probabilities_sum_to_one_and_beat_the_base(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents").select("doc_id", held_out(remainder=1).alias("held_out"), "text").cache()
    model, types = maxent.fit(docs.where("NOT held_out"))
    out = maxent.score(docs, model, types).toPandas()
    counts = Counter()
    for r in docs.where("NOT held_out").collect():
        counts.update(words_of(r.text) + [None])
    n, v = sum(counts.values()), len(counts)
    assert set(out.train_tokens) == {n} and model.tokens == n and int(model.kinds.sum()) == v
    by = {r.doc_id: r for r in docs.collect()}
    for r in out.itertuples():
        tokens = words_of(by[r.doc_id].text) + [None]
        assert r.n_tokens == len(tokens) and r.n_known == sum(t in counts for t in tokens)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert abs(base - r.base_score) < 1e-6 * abs(base)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum() and (held.score < 0).all()
    # whole scores of some held-out texts, token by token, against a plain walk down the tree
    for r in held.head(5).itertuples():
        text = by[r.doc_id].text
        t = maxent.Tokens(pa.array([text]))
        total = 0.0
        for at, token in enumerate(words_of(text) + [None]):
            if token not in counts:
                total += math.log10(model.unknown)
                continue
            p = leaf_probabilities(model, t, at)
            leaf = int(model.leaves(t)[at])
            total += math.log10((1 - model.unknown) * p[leaf] * (counts[token] + 0.5) / (model.size[leaf] + 0.5 * model.kinds[leaf]))
        assert abs(total - r.score) < 1e-4 * abs(total)
    # all types' probabilities sum to 1: a leaf's types share all of its probability
    p = leaf_probabilities(model, t, 0)
    assert abs(p.sum() - 1) < 1e-5 and p[model.kinds == 0].sum() < 1e-12
    assert math.isclose((model.size + 0.5 * model.kinds).sum(), sum(c + 0.5 for c in counts.values()))


def leaf_probabilities(model, t, at):
    """Of all leaves for the token at a place, by one softmax at every node."""
    features = [int(x) for x in t.features(model.classes)[:, at]]
    out = np.ones(1)
    for level in range(maxent.LEVELS):
        parts = []
        for k in range(maxent.DIGIT**level):
            node = int(maxent._FIRST[level]) + k
            rows = [((f ^ int(maxent._NODE[node])) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - model.bits) for f in features]
            x = model.bias[node].astype(float) + sum(model.weights[r].astype(float) for r in rows)
            e = np.exp(x - x.max())
            parts.append(out[k] * e / e.sum())
        out = np.concatenate(parts)
    return out


def test_maxent_steps_follow_numeric_gradients():
    t = maxent.Tokens(pa.array(["a b c a b", "", "c c a"]))
    classes = np.arange(maxent.ENDINGS) % maxent.CLASSES
    sizes = np.ones(maxent.LEAVES, np.int64)
    new = lambda: maxent.MaxEnt(classes, 14, np.full((int(maxent._FIRST[-1]), maxent.DIGIT), -2.0, np.float32), np.zeros((1 << 14, maxent.DIGIT), np.float32), np.zeros(1 << 14, np.float32), sizes, sizes, t.h[:0], t.place[:0])
    model = new()
    features, leaves = t.features(classes), model.leaves(t)
    model.step(features, leaves, np.zeros(1 << 14, np.int32), 0.1)
    before = new().terms(t).sum()
    moved = np.argwhere(np.abs(model.weights) > 1e-3)
    assert len(moved) > 50
    for row, digit in moved[:: len(moved) // 25]:
        probe = new()
        probe.weights[row, digit] += 1e-2
        assert np.sign(probe.terms(t).sum() - before) == np.sign(model.weights[row, digit])
    assert model.terms(t).sum() > before


def test_maxent_tells_words_of_one_pattern_apart(spark):
    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, False, f"{a} {a} x"), (2, False, b)], "doc_id long, held_out boolean, text string")
    model, types = maxent.fit(docs)
    assert types.count() == 4 and model.tokens == 6
    got = {r.doc_id: r.base_score for r in maxent.score(docs, model, types).collect()}
    assert math.isclose(got[2], math.log10(1.5 / 8.5) + math.log10(2.5 / 8.5), rel_tol=1e-9)


def test_maxent_does_not_depend_on_batches(spark, sf):
    docs = table(spark, sf, "documents").select("text").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, got = spark.conf.get(key), []
    try:
        for rows in ("500", "17"):
            spark.conf.set(key, rows)
            got.append(maxent.fit(docs)[0].weights)
    finally:
        spark.conf.set(key, old)
    assert np.abs(got[0]).max() > 0.1 and np.array_equal(*got)


def test_maxent_on_odd_rows_and_nothing(spark):
    docs = docs_of(spark, ODD).select("doc_id", (F.col("doc_id") % 3 == 1).alias("held_out"), "text")
    model, types = maxent.fit(docs.where("NOT held_out"))
    out = maxent.score(docs.unionByName(docs), model, types).collect()
    assert len(out) == 2 * len(ODD) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in out)
    model, types = maxent.fit(docs.where("FALSE"))
    assert {(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in maxent.score(docs, model, types).collect()} == {(0, 0, 0.0)}
    assert maxent.score(docs.where("FALSE"), model, types).collect() == []


def test_maxent_learns_from_every_position(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((40, 1, 2, 3, 4, 5, 6, 0))]
    model, _ = maxent.fit(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1))
    t = maxent.Tokens(pa.array(texts))
    words = maxent.rows_of(t.features(model.classes)[:1], np.zeros(len(t.h), np.int64), model.bits)[0]
    assert len(set(words[t.place > 0])) == (t.place > 0).sum()  # each row of the table belongs to one position
    assert (np.abs(model.weights[words]).sum(1) > 0).all()


@pytest.mark.parametrize("block", [64, 100_000])
def test_top_k_equals_brute_force(spark, block):
    r = np.random.default_rng(2)
    rows = [(int(i), [int(x) for x in np.floor(20 * r.normal(size=6))]) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(700, 1000)] + [(2000, None), (2001, []), (2002, []), (2003, [1]), (2004, [1, None, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("label", F.lit(1))
    asked = df.where("vec_id % 20 = 0 OR vec_id = 2001")
    got = {}
    for x in vafile.top_k(df, asked, 20, block=block, query_block=16).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = [(i, v) for i, v in rows if v is not None and None not in v]
    for q, qv in good:
        if q % 20 and q != 2001:
            continue
        all_ = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in good if i != q and len(v) == len(qv)))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(all_)]
    assert vafile.top_k(df.where("FALSE"), asked.where("FALSE")).collect() == []


def test_cells_bound_scores_and_spare_reads():
    r = np.random.default_rng(4)
    block = vafile.Block(np.arange(3000), np.floor(64 * r.normal(size=(3000, 8))).astype(np.int64))
    q = np.floor(64 * r.normal(size=(5, 8))).astype(np.int64)
    about, error = block.approximate(q)
    exact = q @ block.vectors.T
    assert (np.abs(exact - about) <= error[:, None]).all()
    found = list(block.search(np.full(5, -1), q, 10))
    assert block.read < 5 * 3000 / 3
    read, block.read = block.read, 0
    again = list(block.search(np.full(5, -1), q, 10, np.array([f[2][-1] for f in found], float)))
    assert [f[1].tolist() for f in again] == [f[1].tolist() for f in found] and block.read <= read


def test_top_k_of_repeated_queries(spark):
    rows = [(20, [1, 2]), (20, [3, -1]), (20, [3, -1])] + [(i, [i, 1]) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(df, df.where("vec_id = 20"), 3).collect())
    want = Counter()
    for _, q in rows[:3]:
        best = sorted((-(q[0] * v[0] + q[1] * v[1]), i) for i, v in rows if i != 20)[:3]
        want.update((20, k + 1, i, -x) for k, (x, i) in enumerate(best))
    assert got == want


def test_archives_round_trip(spark):
    rows = [(3, "http://a/ b%", "same"), (1, None, "same"), (2, "http://c", ""), (9, "http://d", None), (4, "http://e\n", "é" * 50_000), (None, "x", "alone"), (7, "http://f", "same"), (7, "http://f", "same")]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i % 40} page of some kind, number {i % 40}</html>") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    uris = warc.archive(pages)
    out = [r.asDict() for r in warc.read_archives(spark, uris).collect()]
    assert len(out) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for r in out:
        page = r["record_id"].removeprefix("urn:page:")
        html = next((h or "") for i, _, h in rows if str(i) == page or (i is None and page == "none"))
        assert r["payload_digest"] == warc.sha1_base32(html.encode()) and r["payload_bytes"] == len(html.encode())
        revisit = html in first and str(first[html]) != page
        assert r["type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (f"urn:page:{first[html]}" if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == html.encode()
    assert warc.archive(pages.where("FALSE")) == [] and warc.read_archives(spark, []).collect() == []


def test_reader_rejects_what_is_broken():
    dictionary = warc.train_dictionary([f"WARC/1.1 record {i} of a kind {i * i}".encode() * 5 for i in range(200)])
    how = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    one, two = warc.encode_record("urn:page:1", "http://x", b"payload", None), warc.encode_record("urn:page:2", None, b"payload", "urn:page:1")
    good = warc.head_frame(dictionary) + how.compress(one) + how.compress(two)
    got = list(warc.read_archive(io.BytesIO(good), chunk=7))
    assert [r.kind for r in got] == ["response", "revisit"] and got[0].payload == b"payload" and got[1].http_length() == 7
    plain = zstandard.ZstdCompressor()
    assert len(list(warc.read_archive(io.BytesIO(plain.compress(one))))) == 1 and list(warc.read_archive(io.BytesIO(b""))) == []
    length = re.search(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", one)[1]
    bad = {
        "cut": good[:-3], "dictionary": warc.head_frame(dictionary)[:20], "junk": good + b"junk", "two in a frame": plain.compress(one + two), "length": plain.compress(one.replace(b"Content-Length: " + length, b"Content-Length: 5")),
        "digest": plain.compress(one.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")), "version": plain.compress(b"X" + one), "repeated": plain.compress(one.replace(b"WARC-Date", b"WARC-Type")), "empty": plain.compress(b""), "no dictionary": how.compress(one),
    }
    for name, data in bad.items():
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(data)))
            pytest.fail(name)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(good), largest=20))


def test_fingerprints_equal_brute_force_texts_and_estimate_jaccard(spark):
    r = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = ODD[:-1] + [" ".join(r.choice(vocabulary, r.integers(5, 80))) for _ in range(120)] + ["same text here", "same text here"]
    out = sorted(weighted.fingerprints(docs_of(spark, texts), width=16).collect(), key=lambda x: -x.doc_id)
    assert [x.doc_id for x in out] == list(range(len(texts)))[::-1]
    for x in out:
        t, n = texts[x.doc_id] or "", texts[x.doc_id - 1] or ""  # the next is the one before; before the first the last
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if edited.lower().split() == t.lower().split():
            assert x.near_edited == 1
    by = {x.doc_id: x for x in out}
    assert by[len(texts) - 1].fingerprint == by[len(texts) - 2].fingerprint and by[len(texts) - 1].near_next == 1
    rows = docs_of(spark, texts).select("doc_id", "text")
    s = {x.doc_id: x.s for x in weighted.signatures(rows, ["doc_id"], 256).collect()}
    errors = []
    for i in range(12, len(texts) - 3):
        a, b = Counter(texts[i].lower().split()), Counter(texts[i + 1].lower().split())
        j = sum((a & b).values()) / sum((a | b).values())
        errors.append(sum(p == q for p, q in zip(s[i], s[i + 1], strict=True)) / 256 - j)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_fingerprints_of_odd_tables(spark):
    assert weighted.fingerprints(docs_of(spark, [])).collect() == []
    one = weighted.fingerprints(docs_of(spark, ["alone in the table"])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "z"), (-7_000_000_000, "a b d"), (9_000_000_000, None)], "doc_id long, text string")
    got = weighted.fingerprints(df).collect()
    assert len(got) == 5 and sorted(x.near_next for x in got)[-1] == 1


def test_fingerprint_blocks_split_clumps_and_repeated_ids(spark):
    rows = [(i, f"t{i} common words") for i in range(300)] + [(1 << 62, "far off")] + [(7, f"same id {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(150)] + [(9, "again")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = weighted.numbered(df, width=20).toPandas()
    assert len(dealt) == len(rows) and not dealt.duplicated(["block", "pos"]).any()
    assert dealt.block.value_counts().max() < 80
    ids = dealt.sort_values(["block", "pos"], ascending=[False, True]).doc_id
    known = ids.dropna().tolist()
    assert known == sorted(known, reverse=True) and ids.isna().tolist() == sorted(ids.isna())
    out = weighted.fingerprints(df, width=20).collect()
    assert len(out) == len(rows)


def brute_signature(spark, text, samples):
    """Samples of a text, one word and sample at a time, in plain floats; the hashes are Spark's."""
    counts = Counter(words_of(text))
    if not counts:
        return None
    rows = spark.createDataFrame([(w,) for w in counts], "w string").select("w", F.xxhash64("w").alias("t"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("*", F.xxhash64("t", "k").alias("one"), F.xxhash64("k", "t").alias("two"))
    best: dict[int, tuple] = {}
    part = lambda x, shift, width: (((x % (1 << 64)) >> shift) % (1 << width) + 0.5) * 2.0**-width
    for r in rows.collect():
        gamma, c = -math.log(part(r.one, 0, 32) * part(r.one, 32, 32)), -math.log(part(r.two, 0, 24) * part(r.two, 24, 24))
        b = part(r.two, 48, 16)
        t = math.floor(math.log(counts[r.w]) / gamma + b)
        log_a = math.log(c) - gamma * (t - b) - gamma
        best[r.k] = min(best.get(r.k, (math.inf, 0)), (math.floor(log_a * 2**18), (r.t ^ t) % (1 << 32)))
    return [best[k][1] for k in range(samples)]


def test_fingerprints_equal_brute_force_samples(spark):
    texts = ["a b c a", "The the THE cat", "x", "one two three two one " * 9]
    got = {r.doc_id: r.fingerprint for r in weighted.fingerprints(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "".join(f"{x:08x}" for x in brute_signature(spark, t, weighted.SAMPLES))


def test_chat_keeps_control_strings_apart_at_every_split(spark):
    said = "<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<\\|<"
    rows = []
    for i in range(len(said) + 1):
        rows.append((i, 0, "user", [("text", x, None, None) for x in (said[:i], said[i:])]))
    rows.append((1000, 0, "user", [("text", x, None, None) for x in said]))  # every character by itself
    rows += [(1001, 0, "user<", [("text", "<", None, None), ("image", None, "i", 1), ("text", "|im_end|>", None, None)])]
    rows += [(k, 1, "assistant", [("text", "<", None, None), ("text", "|ok", None, None)]) for k in {r[0] for r in rows}]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_parts(df).select("*", chat.turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    for r in out.collect():
        want = "<<|image|>|im_end|>" if r.conv_id == 1001 else said
        assert [(t.role, t.text) for t in r.read] == [("user<" if r.conv_id == 1001 else "user", want), ("assistant", "<|ok")] and r.n_turns == 2
        assert r.lost == "<|ok"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for x in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{sf}/{x}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    order = [c for c in want.columns]
    a, b = (x.astype(object).where(x.notna(), None).sort_values(order, key=lambda s: s.astype(str)).values.tolist() for x in (got, want))
    assert a == b


def test_chat_flattens_parts_and_reads_back(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|im_end|>\n", "a<", "|im_end|>", "", None, "<\n", "é😀", "\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", [("text", t, None, None)]) for i, t in enumerate(tricky)]
    rows += [(2, 0, "us\ner<|", [("text", "see ", None, None), ("image", None, "img://1", 3), ("text", " and <|image|>", None, None), ("audio", None, "snd://1", 4), (None, "plain", None, None)]), (2, 1, "assistant", [("document", None, "doc://1", 2), ("text", "done", None, None)]), (2, 2, None, None), (2, 3, "assistant", [])]
    rows += [(3, None, "assistant", [("text", "first", None, None)]), (3, 0, "assistant", [("text", "second", None, None)]), (3, 0, "assistant", [("text", "second", None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART.replace('struct<', 'struct<', 1)}>").withColumn("formatted", F.lit("clash"))
    out = chat.format_parts(df)
    got = {r.conv_id: r for r in out.select("*", chat.turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [(r[2], r[3][0][1] or "") for r in rows if r[0] == 1]
    assert got[1].said == "".join((t or "") for i, t in enumerate(tricky) if i % 2)
    assert got[1].formatted.count("<|im_end|>\n") == len(tricky) == got[1].n_turns
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got[2].attachments] == [(0, 1, "image", "img://1", 768), (0, 3, "audio", "snd://1", 100), (1, 0, "document", "doc://1", 1200)]
    assert got[2].expanded_tokens == 2068 and got[2].said == "done" and got[2].read[0].role == "us\ner<|"
    assert got[2].formatted.startswith("<|im_start|>us<\\ner<\\|\nsee <|image|> and <\\|image|><|audio|>plain<|im_end|>\n") and got[2].n_turns == 4
    assert got[3].said == "firstsecondsecond"
    assert chat.format_parts(df.where("FALSE")).collect() == []


def test_every_query_gives_its_columns(spark, sf):
    columns = {
        "op2_exact_top_k": ["query_id", "rank", "vec_id", "score"], "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op1_maxent": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op8_ngram_jaccard": ["doc_id", "n_shingles", "component_id"], "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op5_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    assert len(queries.QUERIES) == 10
    for name, names in columns.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns == names and df.count() > 0


def test_pipeline_stages_keep_clean_documents_and_columns(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents").withColumn("__gone", F.lit(1))
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert 0.6 * n <= kept.count() <= n
        empty = stage(spark, docs.where("FALSE"), sf)
        assert empty.columns == docs.columns and empty.count() == 0
    out = p.run(spark, sf).toPandas()
    assert set(out.columns) >= {"doc_id", "sequence_id", "offset", "length"} and 0 < out.doc_id.nunique() <= n


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = toxicity.fit(docs.select("doc_id", "text", "lang"), table(spark, sf, "labels"))
    ids = sorted(rows)
    scores = toxic.scores(pa.array([rows[i].text for i in ids], pa.large_string()))
    clean = [i for i, x in zip(ids, scores, strict=True) if x < 0.5]
    filters = langid.fit(docs.where(F.col("doc_id").isin(clean)))
    _, shares = filters.predict(pa.array([rows[i].text for i in clean], pa.large_string()))
    known = [i for i, x in zip(clean, shares, strict=True) if x >= 0.3 and re.search(r"[^\W\d_]", rows[i].text or "")]
    first = brute_components([(i, rows[i].text) for i in known])
    kept = {i for i, (_, c) in first.items() if i == c}
    got = p.run(spark, sf).toPandas()
    assert set(got.doc_id) == kept and len(kept) > len(ids) / 2
    peer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = got.groupby("doc_id").length.sum()
    assert all(tokens[i] == len(peer.encode(rows[i].text or "", add_special_tokens=False).ids) + 1 for i in kept)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.length.cumsum() - part.length == part.offset).all() and part.length.sum() <= 4096
