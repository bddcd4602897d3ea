"""Tokenizing, language ID, toxicity, near duplicates and packing against brute force, with odd rows."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bytebpe, common, jaccard, langid, packing, toxicity
from sparkloom.llm.wordpieces import ChunkEncoder

LONG = "word " * 30_000
ODD = [None, "", " \n\t", "a", "A b", "é", "日本 語", "x" * 5000, "one two three four", "one two three four five", "😀 \x1c \x85 end", LONG]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, prefix string"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)], DOCS)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(t))


def test_words_hash_alike_exactly_when_equal():
    texts = ["Ab ab AB", None, "", "ab\tc ", "é É", "x"]
    w = common.Words(pa.array(texts))
    h = w.hashes()
    seen = {}
    for i, t in enumerate(texts):
        mine = h[w.first[i] : w.first[i + 1]].tolist()
        assert len(mine) == len(words_of(t))
        for word, value in zip(words_of(t), mine, strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def thue_morse(bits=10):
    """A word and its complement, which polynomial hashes modulo a power of two can't tell apart."""
    word = ""
    for i in range(1 << bits):
        word += "ab"[bin(i).count("1") % 2]
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [6, 10, 12])
def test_words_of_one_pattern_hash_apart(bits):
    a, b = thue_morse(bits)
    assert len(set(common.Words(pa.array([a, b, a + "x"])).hashes().tolist())) == 3


def test_spans_compare_byte_by_byte():
    texts = ["", "a", "abcdefgh", "abcdefghi", "abcdefghj", "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 200, "x" * 199 + "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    assert common.same_bytes(data, start[i], end[i], data, start[j], end[j]).tolist() == (i == j).tolist()


def brute_components(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            c = len(sets[a] & sets[b])
            if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("share", [4, 4000])
def test_jaccard_join_equals_brute_force(spark, share):
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(r.choice(vocabulary, r.integers(3, 60))) for _ in range(25)]
    passage = list(r.choice(vocabulary, 40))
    texts = list(ODD) + list(ODD[-4:]) + list(thue_morse()) + [f"{x} is one word of five" for x in thue_morse()]
    for _ in range(220):  # near copies at all distances, many around the threshold, and a passage that many share
        b = list(base[r.integers(len(base)) if r.random() < 0.6 else 0])
        for _ in range(r.integers(0, 5)):
            b[r.integers(len(b))] = str(r.choice(vocabulary))
        texts.append(" ".join(b + (passage if r.random() < 0.3 else [])))
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar(docs_of(spark, texts), share=share).collect()}
    want = brute_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 50
    kept = {x.doc_id for x in jaccard.keep_one(docs_of(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_join_on_empty_null_and_repeated_rows(spark):
    assert jaccard.similar(docs_of(spark, [])).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b"), (5, "A b c d e  f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar(df).collect()) == [(1, 2, 1), (1, 2, 1), (5, 2, 1)]


def test_jaccard_links_sizes_far_apart_at_low_percent(spark):
    texts = []
    for g in range(8):  # the long text leads the two others' shingles but links with neither
        w = [f"g{g}w{k}" for k in range(1064)]
        texts += [(3 * g, " ".join(w)), (3 * g + 1, " ".join(w[:104])), (3 * g + 2, " ".join(w[:164]))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), percent=60, share=1, rounds=1).collect()}
    assert got == {(3 * g + k, n, 3 * g + (k > 0)) for g in range(8) for k, n in enumerate((1060, 100, 160))}


def test_byte_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bytebpe.read_ranks(path)
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(5)
    bits = ["aa", "a", "the", " ", "  ", "\n", "é", "😀", "\x1c", "\x85", "123", "ing", '"', "....", "日本", "́", "'s", "zzzz", "<|endoftext|>"]
    texts = ODD + ["".join(r.choice(bits, r.integers(1, 40))) for _ in range(300)] + ["ab" * 4000, " " * 3000]
    out = {x.doc_id: x for x in bytebpe.encode(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(out[i].ids, "<u4").tolist() == peer.encode_ordinary(t or "")
        assert bytes(out[i].decoded) == (t or "").encode()
    coder = bytebpe.ByteBPE(path, public_tokenizers.PATTERN, most=5)  # memos that overflow
    assert all(np.frombuffer(coder.encode(t or ""), "<u4").tolist() == peer.encode_ordinary(t or "") for t in texts[:60])
    assert bytebpe.encode(docs_of(spark, []), path, public_tokenizers.PATTERN).collect() == []


def test_chunk_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    peer = Tokenizer.from_file(path)
    mine = ChunkEncoder(path, most=20)
    texts = [x for x in ODD if x] + ["It's <|endoftext|> ÉÈ ÇA 12 don't", "a<|endoftext|><|startoftext|>b.", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "İstanbul ΣΑΣ", "á ́b", "x\x1fy z", "¯ ¢ ×", *thue_morse()]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == peer.encode(t, add_special_tokens=False).ids, t
    ids, first = mine.encode_column(pa.array([*texts, None]), 2)
    for t, a, b in zip([*texts, ""], first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == [*peer.encode(t, add_special_tokens=False).ids, 2]


def test_chunk_encoder_tells_words_of_one_hash_apart(monkeypatch):
    from sparkloom.llm import wordpieces

    monkeypatch.setattr(wordpieces, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    peer = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    mine = ChunkEncoder(path)
    for t in ["one two six ten", "two owt one", "three seven"] * 2:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == peer.encode(t, add_special_tokens=False).ids, t


def test_chunk_encoder_refuses_other_tokenizers(tmp_path):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.normalizer = None  # upper case is told from lower case
    own.save(str(tmp_path / "own.json"))
    with pytest.raises(ValueError):
        ChunkEncoder(str(tmp_path / "own.json"))


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(64, 8, 20)])
def test_packing_keeps_all_limits_and_every_token(spark, limits):
    texts = ODD + [f"some words {i} and more " * (i % 7) for i in range(200)]
    docs = docs_of(spark, texts).repartition(3)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limits=limits).toPandas()
    peer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        ids = np.array(peer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        assert (own.length.cumsum() - own.length == own.start).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all()
        total = int(s.length.sum())
        assert total <= limits.tokens and len(s) <= limits.segments and total <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_packing_counts_loss_from_the_prompt_on():
    packer = packing.Packer(packing.Limits(32, 10, 8), window=4)
    sizes = {k: (10 + k % 23, 5 + k % 11) for k in range(60)}
    pieces = [p for k, (n, free) in sizes.items() for p in packer.add(k, n, free)] + list(packer.finish())
    by = {}
    for key, start, length, seq, offset in pieces:
        by.setdefault(seq, []).append((key, start, length, offset))
    for parts in by.values():
        assert sum(p[2] for p in parts) <= 32 and len(parts) <= 10
        assert sum(max(0, s + n - max(s, sizes[k][1])) for k, s, n, _ in parts) <= 8
    assert sum(p[2] for p in pieces) == sum(n for n, _ in sizes.values())


def test_language_filters_have_no_false_negatives_and_correct_false_positives():
    r = np.random.default_rng(1)
    codes = {name: r.integers(0, 1 << 32, 5000, dtype=np.uint32) for name in ("aa", "bb", "cc")}
    f = langid.LanguageFilters.build(codes, bits=16)
    for k, name in enumerate(f.languages):
        assert ((f.masks(codes[name]) >> np.uint64(k)) & np.uint64(1)).all()
    rate = ((f.masks(r.integers(0, 1 << 32, 200_000, dtype=np.uint32)) >> np.uint64(1)) & np.uint64(1)).mean()
    assert abs(rate - f.false[1]) < 0.3 * f.false[1] + 1e-3


def test_language_filters_of_more_languages_than_a_word_has_bits():
    r = np.random.default_rng(2)
    words = {f"l{i:03d}": ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(40)] for i in range(150)}
    f = langid.LanguageFilters.build({k: langid.grams(pa.array(w))[0] for k, w in words.items()}, bits=17)
    assert f.slots.shape == (3, 1 << 17)
    best, share = f.predict(pa.array([" ".join(w[:5]) for w in words.values()]))
    assert [f.languages[b] for b in best] == list(words) and (share > 0.5).all()


def test_language_sample_is_even_over_languages(spark):
    shares = langid._even_shares({"a": 1_000_000, "b": 1_000_000, "c": 10}, 1_000)
    assert shares["c"] == 1 and shares["a"] == shares["b"] == 495 / 1_000_000
    assert langid._even_shares({}, 5) == {} and langid._even_shares({"a": 3}, 5) == {"a": 1}
    texts = ["the cat and the dog are here"] * 400 + ["le chat et le chien sont ici"] * 12
    docs = docs_of(spark, texts, ["en"] * 400 + ["fr"] * 12)
    assert langid.fit(docs, sample=40).languages == ["en", "fr"]


def test_language_of_odd_rows(spark):
    texts = ["the cat and the dog are here"] * 30 + ["le chat et le chien sont ici"] * 30 + ODD + ["12 34 !!", "le chien", "THE DOG"]
    langs = ["en"] * 30 + ["fr"] * 30 + [None] * (len(ODD) + 3)
    docs = docs_of(spark, texts, langs)
    model = langid.fit(docs)
    out = {r.doc_id: (r.lang_pred, r.lang_score, r.a) for r in langid.identify(docs, model).collect()}
    assert len(out) == len(texts) and all(0 <= s <= 1 and a == "clash" for _, s, a in out.values())
    assert all(out[i][0] == langs[i] for i in range(60))
    n = len(texts)
    assert [out[i][0] for i in (n - 3, n - 2, n - 1)] == ["und", "fr", "en"]
    assert [out[60 + i][0] for i in range(3)] == ["und"] * 3
    assert langid.keep_identified(docs, model).columns == docs.columns
    assert langid.identify(docs_of(spark, []), langid.fit(docs_of(spark, []))).collect() == []


def test_language_held_out_accuracy(spark, sf):
    docs = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    model = langid.fit(docs)
    out = langid.identify(docs, model).where(common.held_out()).select("lang", "lang_pred").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97


def test_toxicity_held_out_and_odd_rows(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = common.table(spark, big, "documents"), common.table(spark, big, "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.join(labels, "doc_id").where(common.held_out()), model).select("toxic", "toxicity").toPandas()
    said = out.toxicity >= 0.5
    assert said[out.toxic == 1].mean() > 0.8 and said[out.toxic == 0].mean() < 0.02
    odd = docs_of(spark, ODD)
    scores = [r.toxicity for r in toxicity.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    empty = toxicity.fit(docs_of(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs_of(spark, []), empty).collect() == []
    assert len(toxicity.score(odd, empty).collect()) == len(ODD)


def test_training_with_empty_texts_at_every_place():
    r = np.random.default_rng(8)
    texts = [toxicity.features(pa.array([" ".join(r.choice(["bad", "good", "so", "x"], n))]), 8)[0] for n in (3, 1, 2, 5, 4)]
    for at in range(6):
        model = toxicity.ToxicityModel(bits=8)
        some = texts[:at] + [texts[0][:0]] + texts[at:]
        model.train(some, np.array([i % 2 for i in range(6)]), epochs=2, batch=3)
        assert np.isfinite(model._logits(np.concatenate(some), np.cumsum([0, *map(len, some)]))).all()


def test_gradient_steps_lower_the_loss_like_numeric_gradients():
    texts = pa.array(["alpha beta gamma", "", "delta beta", "x y z alpha"])
    labels = np.array([1, 0, 0, 1])
    buckets, first = toxicity.features(texts, 8)
    own = [buckets[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def loss(m):
        x = m._logits(buckets, first)
        return np.mean(np.log1p(np.exp(-np.where(labels == 1, x, -x))))

    model = toxicity.ToxicityModel(bits=8)
    before, e0, v0, k0 = loss(model), model.e.copy(), model.v.copy(), [k.copy() for k in model.k]
    moved = toxicity.ToxicityModel(bits=8)
    moved.train(own, labels, epochs=1, batch=4, rate=1e-3)
    # Adagrad's first step goes against the sign of the gradient, weight by weight
    for name, old, new in (("v", v0, moved.v), ("k", k0[1], moved.k[1])):
        flat = np.argsort(-np.abs(new - old).ravel())[:12]
        for i in flat:
            probe = toxicity.ToxicityModel(bits=8)
            (probe.v if name == "v" else probe.k[1]).reshape(-1)[i] += 1e-2
            slope = loss(probe) - before
            assert abs(slope) < 1e-6 or np.sign(slope) == -np.sign((new - old).ravel()[i])
    assert loss(moved) < before and not np.array_equal(moved.e, e0) and (moved.e[0] == 0).all()


def test_toxicity_fits_odd_labelled_texts(spark):
    texts = [*ODD, *ODD, "you are bad bad", "fine day"] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, most_bytes=100_000)
    assert toxicity.score(docs_of(spark, ODD), model).count() == len(ODD)


def test_pooling_equals_a_plain_loop():
    model = toxicity.ToxicityModel(bits=8)
    texts = pa.array(["one two three", "", None, "x", "alpha beta gamma delta " * 9])
    buckets, first = toxicity.features(texts, 8)
    pooled, _, _ = model._pooled(buckets, first)
    for i in range(len(texts)):
        x = model.e[buckets[first[i] : first[i + 1]]].sum(1)
        x = np.concatenate([x.reshape(-1, model.size), np.zeros((3, model.size))])
        at = 0
        for w, k, b in zip(toxicity.WIDTHS, model.k, model.b, strict=True):
            for f in range(model.filters):
                best = max(sum(x[s + j] @ k[j][:, f] for j in range(w)) + b[f] for s in range(len(x) - w + 1)) if len(x) >= w else 0
                assert abs(max(best, 0) - pooled[i, at]) < 1e-4
                at += 1
