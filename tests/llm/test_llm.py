import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import decontaminate, fingerprints, jaccard_join, licenses, queries, sentence_pieces, sharding, store, token_counts, token_files, toxicity, urls

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur. " * 3000
ROWS = [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "one two three four five six seven.\nRest", "en", "s", 9), (3, "one two three four five six seven.\nRest", "en", "s", 9), (4, "One two, three four five six seven.\nREST", "de", "s", 9), (None, "lone", "en", "s", 4), (5, LONG, "en", "s", len(LONG)), (6, LONG + "x", "en", "s", 1), (7, "\n\n", "en", "s", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(1) for c in ("shard", "slot", "ids", "toxic", "class_id", "range", "node", "key", "label", "unit", "words")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(same, name):
    same(queries.queries()[name], queries.oracle_sql()[name])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_edges(odd):
    assert [r.n_matches for r in licenses.summary(odd).collect()] == [0] * len(ROWS)
    assert licenses.summary(odd.limit(0)).count() == 0
    assert "license_matches" in licenses.scan(odd).columns


def test_urls(spark):
    table = [("https://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://a.example.com/en/?q", "a.example.com", "/en/", "example.com/en/", "block"), ("x://example.com", "example.com", "", None, None), ("http://b.net/fr/#a", "b.net", "/fr/", "net/fr/", "block"), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://notexample.com/de", "notexample.com", "/de", "com/", "allow"), ("http://spam-farm.example.org/en/728", "spam-farm.example.org", "/en/728", None, "block"), ("http://thther.example.org/en/1", "thther.example.org", "/en/1", None, "allow")]
    pages = spark.createDataFrame([(i, t[0], "h") for i, t in enumerate(table)], "page_id long, url string, host string")
    got = urls.judge(pages).orderBy("page_id").collect()
    for r, t in zip(got, table, strict=True):
        assert (r.host, r.path, r.rule) == t[1:4] and (t[4] is None or r.verdict == t[4])
    rows = spark.createDataFrame([(u, y) for u, y in urls.LABELLED], "url string, y int")
    p = urls.probability(urls.host(F.col("url")), urls.path(F.col("url")), urls.fit(spark))
    assert rows.filter((p >= 0.5) != (F.col("y") == 1)).count() <= 2


def test_url_model(spark):
    """Features, model and verdicts against a version in Python, on the training table and on URLs not in it."""
    import xxhash

    seen = [u for u, _ in urls.LABELLED]
    fresh = [
        ("https://casino-slots.example.org/win/3", 1), ("http://cheap-pills-shop.example.net/buy-now/9", 1), ("https://spam-farm.example.org/xx/11", 1), ("http://adult-live.example.org/cams/4", 1), ("https://fast-loans.example.org/apply/77", 1),
        ("https://ththou.example.org/en/31", 0), ("http://library.example.net/books/7", 0), ("https://blog.therea.example.org/fr/8.html", 0), ("http://weather.example.org/today/12", 0), ("https://museum.example.net/rooms/2", 0),
    ]

    def split(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def places(url):
        marked = [f"{p}^{x}$" for p, x in zip("hp", split(url), strict=True)]
        grams = [part[i : i + n] for part in marked for n in (3, 4) for i in range(len(part) - n + 1)]
        return [np.int64(np.uint64(xxhash.xxh64(g.encode(), seed=42).intdigest()).view(np.int64)) % 4096 for g in grams]

    def row(url):
        x, at = np.zeros(4097), places(url)
        for k in at:
            x[k] += 20.0 / len(at)
        x[4096] = 1
        return x

    x, y = np.array([row(u) for u in seen]), np.array([float(v) for _, v in urls.LABELLED])
    w = np.zeros(4097)
    for _ in range(200):
        miss = 2.0 / len(y) * (y - 1 / (1 + np.exp(-x @ w)))
        w = np.append(w[:-1] * (1 - 2e-4), w[-1]) + miss @ x
    got = np.array(urls.fit(spark))
    assert np.abs(got - w).max() < 1e-9
    table = [*seen, *(u for u, _ in fresh), None, "no scheme", "HTTP://A.B/C?d#e"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(table)], "page_id long, url string, __keep string")
    judged = urls.judge(pages).orderBy("page_id").collect()
    for r, u in zip(judged, table, strict=True):
        p = 1 / (1 + np.exp(-row(u) @ w))
        assert (r.host, r.path) == split(u) and abs(r.p_block - p) < 1e-9 and r["__keep"] == "x"
        assert r.verdict == {None: "block" if p >= 0.5 else "allow"}.get(r.rule, r.verdict)
    unseen = {r.url: r.verdict for r in judged if r.url in dict(fresh)} if "url" in judged[0].asDict() else {table[r.page_id]: r.verdict for r in judged}
    right = sum((1 / (1 + np.exp(-row(u) @ w)) >= 0.5) == bool(v) for u, v in fresh)
    assert right >= 9 and len(unseen) >= len(fresh)
    assert urls.judge(pages.limit(0)).count() == 0


def test_toxicity(spark, docs):
    """Out-of-fold, and on documents whose labels weren't seen at all."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(docs, labels)
    y, p = chain.labels["toxic"] > 0, chain.held_out["toxic"] >= chain.threshold
    assert (y == p).mean() > 0.93 and (p & ~y).sum() <= 0.02 * (~y).sum()
    assert [len(w) for w in chain.weights] == [len(c) + k + 1 for k, c in enumerate(chain.columns)]
    low = chain.labels["low_quality"] > 0
    assert ((chain.held_out["low_quality"] >= 0.5) == low).mean() > 0.93
    half = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    unseen = toxicity.score(docs, half).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").select("toxic", "y").collect()
    assert np.mean([r.toxic == (r.y == 1) for r in unseen]) > 0.93 and sum(r.toxic and r.y == 0 for r in unseen) <= 0.02 * len(unseen)


def test_toxicity_features():
    """Each text has as many features as distinct words, prefixes, symbol runs and repetitions, and equal ones are equal."""
    texts = ["Ab ab, cdefgh!! cdefgh", "", "!!", "cdefgh cdefghi\n||x", "Straße straße"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = [set() for _ in texts]
    for h, t in toxicity.text_features(np.frombuffer(data, np.uint8), offsets):
        for x, k in zip(h.tolist(), t.tolist(), strict=True):
            found[k].add(x)

    def features(text):
        ws = words(text)
        out = {("w", w) for w in ws} | {("p", w.encode()[:n]) for w in ws for n in (4, 5, 6) if len(w.encode()) > n}
        return out | {("s", x) for x in re.findall(r"[!-/:-@\[-`{-~]+", text)} | {("t",) for a, b in zip(ws, ws[1:]) if a == b}

    want = [features(t) for t in texts]
    assert [len(x) for x in found] == [len(x) for x in want]
    assert all(len(found[i] & found[j]) == len(want[i] & want[j]) for i in range(5) for j in range(5))


def test_chain_against_brute_force(spark, docs):
    """Counts, choice of features, folds and the chain, computed again in Python from the features of the texts."""
    labels = {r.doc_id: (float(r.quality == 0), float(r.toxic)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in labels}
    assert chain.ids.tolist() == sorted(texts)
    fold = {r.doc: r.f for r in docs.select(F.col("doc_id").alias("doc"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)).alias("f")).collect()}
    assert chain.folds.tolist() == [fold[i] for i in chain.ids]
    sets = []
    for i in chain.ids:
        data = np.frombuffer(texts[i].encode(), np.uint8)
        sets.append(np.unique(np.concatenate([h for h, _ in toxicity.text_features(data, np.array([0, len(data)]))])))
    y = np.array([labels[i] for i in chain.ids])

    def chosen(k, without):
        rows = [j for j in range(len(sets)) if chain.folds[j] != without]
        c, c1 = Counter(x for j in rows for x in sets[j].tolist()), Counter(x for j in rows if y[j, k] for x in sets[j].tolist())
        n1 = sum(y[rows, k])
        n0 = len(rows) - n1
        z = {}
        for x, n in c.items():
            share = n / len(rows)
            score = abs(c1[x] / n1 - (n - c1[x]) / n0) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
            if n >= 3 and score >= 4:
                z[x] = score
        return np.array(sorted(sorted(z, key=lambda x: (-z[x], np.uint64(x).view(np.int64)))[:256]), np.uint64)

    matrix = lambda keys: np.array([np.isin(keys, s) for s in sets], np.float32)
    before = np.zeros((len(sets), 0))
    for k, name in enumerate(toxicity.NAMES):
        assert (chain.keys[chain.columns[k]] == chosen(k, -1)).all()
        for f in range(5):
            x = np.hstack([matrix(chosen(k, f)), before])
            out, own = chain.folds != f, chain.folds == f
            want = toxicity.predict(x[own], toxicity.fit_linear(x[out], y[out, k]))
            assert np.abs(chain.held_out[name][own] - want).max() < 1e-3
        before = np.hstack([before, chain.held_out[name][:, None]])


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(odd, none).count() == len(ROWS)
    few = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (4, 0, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.reject(odd, few)
    assert out.columns == odd.columns and 0 < out.count() <= len(ROWS)
    assert toxicity.reject(odd.limit(0), few).count() == 0


def test_token_rollup(spark, odd, docs, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    change = spark.createDataFrame([("insert", "a", "en", "t", 5, None), ("insert", "a", "en", "t", 7, None), ("revise", "a", "en", "t", 9, 7), ("delete", "a", "en", "t", 5, None), ("odd", "b", None, "t", 3, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit(1, change) and not rollup.commit(1, change)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 9)]
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs.collect():
        want[d.source, d.lang] += len(tok.encode(d.text, add_special_tokens=False).ids) + 1
    got = {(r.source, r.lang): r.n_tokens for r in token_counts.maintain(docs).filter("tokenizer = 'byte_bpe_50k'").collect()}
    assert got == dict(want)

    def brute(rows):  # all columns; documents without a word are gone, and with them keys that had no others
        out = Counter()
        for r in rows:
            n = len(words(r.text))
            if n:
                for name, tokens in (("words", n), ("byte_bpe_50k", len(tok.encode(r.text, add_special_tokens=False).ids) + 1)):
                    out[r.source, r.lang, name, "docs"] += 1
                    out[r.source, r.lang, name, "tokens"] += tokens
        keys = {k[:3] for k in out}
        return {(*k, out[*k, "docs"], out[*k, "tokens"]) for k in keys}

    for rows in (docs, odd, odd.limit(0)):
        assert {tuple(r) for r in token_counts.maintain(rows).collect()} == brute(rows.collect())


def test_rollup_folds(spark, tmp_path):
    """Folded batches count once, whatever comes again; a batch that broke off before its mark doesn't count."""
    rollup = token_counts.TokenRollup(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([("insert", "a", None, "t", n, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    for step in range(3):
        for n in (5 * step, 5 * step + 1):
            assert rollup.commit(n, row(10**n))
        rollup.compact()
        assert not rollup.commit(0, row(7)) and rollup.totals().first().n_docs == 2 * step + 2
    assert rollup.totals().first().n_tokens == sum(10**n for n in (0, 1, 5, 6, 10, 11))
    token_counts.deltas(row(3)).write.parquet(str(tmp_path / "batch=99"))
    assert rollup.totals().first().n_docs == 6 and rollup.commit(99, row(4)) and rollup.totals().first().n_docs == 7
    assert token_counts.deltas(row(1).limit(0)).count() == 0
    odd_ops = spark.createDataFrame([(None, "a", "b", "t", 4, None), ("delete", None, None, None, None, 3), ("revise", "a", "b", "t", None, 2)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert {tuple(r) for r in token_counts.deltas(odd_ops).collect()} == {("a", "b", "t", 0, -2), (None, None, None, -1, 0)}


def test_join_edges(odd):
    got = jaccard_join.similarity_links(odd).collect()
    by = {r.doc: r for r in got}
    assert len(got) == len(ROWS) and by[3].n_links == by[4].n_links == 2 and by[4].class_id == 3 and by[1].n_links == by[2].n_links == by[7].n_links == 0
    assert by[5].n_links == 1 and by[6].class_id == 5 and by[6].n_text_links == 1
    kept = jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "7", "None"]
    assert jaccard_join.deduplicate(odd.limit(0)).count() == 0
    assert jaccard_join.similarity_links(odd.limit(0)).count() == 0


def test_deduplicate_by_row(spark):
    """Rows go by id and text: unrelated texts under a repeated id stay, as do texts without words."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    near = x.replace("x39", "other")
    cases = [
        ([(3, x), (7, x), (7, z)], [(3, x), (7, z)]),
        ([(3, x), (3, x), (3, z)], [(3, x), (3, z)]),
        ([(3, x), (3, x), (7, x.upper())], [(3, x)]),
        ([(None, x), (1, x), (None, y), (2, y), (None, z)], [(None, x), (None, y), (None, z)]),
        ([(5, near), (4, x), (4, y), (5, y), (4, None), (4, None), (4, "...")], [(4, x), (4, y), (4, None), (4, None), (4, "...")]),
    ]
    key = lambda r: tuple(map(str, r))
    for rows, want in cases:
        got = jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    both = jaccard_join.deduplicate(spark.createDataFrame([(1, x), (1, near), (2, x)], "doc_id long, text string")).collect()
    assert len(both) == 1 and both[0].doc_id == 1


def test_components(spark):
    """Stars, chains and cycles; the labels are the least nodes."""
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 340)] + [(400, 401), (401, 402), (402, 400), (500, 500)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(200)} | {k: 300 for k in range(300, 341)} | {k: 400 for k in (400, 401, 402)}


def test_join_blocks(spark, monkeypatch):
    """A group in many salted blocks has the links that brute force finds."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(jaccard_join, "BUCKET", 6)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for k in rng.integers(0, 120, 3):
            t[k] = f"z{rng.integers(0, 9)}"
        texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = [sum(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = jaccard_join.similarity_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc").collect()
    assert [r.n_links for r in got] == want and sum(want)


def test_posterior():
    need = [jaccard_join.least_matches(n) for n in range(16, 97, 16)]
    assert need == sorted(need) and 0 < need[0] < 16 and need[-1] < 0.8 * 96


def test_pieces(spark, odd):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [(t,) for t in (None, "", " a  b ", "Ünïcode 日本 😀\n\tx", "<s> 12 ...", "x" * 70, "ab" * 300, "thtionble, thtionble!", LONG)]
    rows = spark.createDataFrame(texts, "text string").withColumn("ids", F.lit(0))
    rows = rows.withColumns({c: F.lit(c) for c in ("row", "parts", "unit", "pos", "n", "path", "best")})
    for bound in (sentence_pieces.BROADCAST_BYTES, 0):
        made = sentence_pieces.encode(rows, broadcast_bytes=bound, decoded_col="back", path_col="way")
        assert made.columns == ["text", "row", "parts", "unit", "pos", "n", "path", "best", "ids", "way", "back"]
        got = made.collect()
        for r in got:
            assert list(r.ids) == sp.encode(r.text or "") and r.back == (r.text or "") and (r.row, r.parts) == ("row", "parts")
            assert sp.decode(list(r.way)) == (r.text or "") or "<s>" in r.text
        assert len(got) == len(texts) and sentence_pieces.encode(rows, broadcast_bytes=bound).filter("text is null").first().ids == []
        assert sentence_pieces.encode(odd, broadcast_bytes=bound).count() == len(ROWS) and sentence_pieces.encode(odd.limit(0), broadcast_bytes=bound).count() == 0


def test_pieces_of_documents(spark, docs):
    """On whole documents: the library's ids, and the path of the best sum of scores by dynamic programming in Python."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = sentence_pieces.public_pieces()()
    score = {p: s for p, s, _ in pieces.rows}
    name = {i: p for p, _, i in pieces.rows}
    bytes_ = set(pieces.byte_ids)

    def best(text):  # the text's best sum over all pieces, whatever its units are
        text = sentence_pieces.SPACE + text.replace(" ", sentence_pieces.SPACE)
        sums = [0.0]
        for e in range(1, len(text) + 1):
            sums.append(min(sums[b] + (-score[text[b:e]] if text[b:e] in score else 2e9) for b in range(max(0, e - pieces.longest), e) if text[b:e] in score or b == e - 1))
        return sums[-1]

    got = queries.op6_sentence_pieces(spark, SF).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id < 150").collect()
    assert len(got) > 100 and all(r.round_trip for r in got)
    for r in got:
        assert list(r.ids) == sp.encode(r.text) and sp.decode(list(r.best_path)) == r.text
        if not bytes_ & set(r.best_path):
            assert sum(-score[name[i]] for i in r.best_path) == best(r.text)
    assert any(list(r.ids) != list(r.best_path) for r in got)


def test_viterbi(spark):
    table = (("a", -3.0, 0), ("b", -3.0, 1), ("ab", -4.0, 2), ("ba", -3.5, 3), ("bab", -9.0, 4), ("▁", -1.0, 5))
    pieces = sentence_pieces.Pieces(table, None, 9, tuple(p.encode() for p, _, _ in table))
    score = {p: (s, i) for p, s, i in table}

    def best(u):
        return max((((score[u[:k]][0] if u[:k] in score else -19.0 if k == 1 else -1e9) + best(u[k:])[0], (score[u[:k]][1] if u[:k] in score else 9, *best(u[k:])[1])) for k in range(1, len(u) + 1)), default=(0.0, ()))

    units = ["▁ab", "▁bab", "▁babab", "▁xab", "abba"]
    got = {r.unit: tuple(r.ids) for r in sentence_pieces.viterbi_fold(spark.createDataFrame([(u,) for u in units], "unit string").repartition(2, "unit"), pieces).collect()}
    cost = lambda ids: sum(next((s for _, s, i in table if i == k), -19.0) for k in ids)
    assert all(abs(cost(got[u]) - best(u)[0]) < 1e-9 for u in units)


def test_decode_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, sentence_pieces.public_pieces()().merge("▁one"), "x")], "k long, ids array<int>, decoded string")
    assert {r.k: r.decoded for r in sentence_pieces.decode(rows).collect()} == {1: None, 2: "", 3: "one"}
    assert sentence_pieces.decode(rows.limit(0)).count() == 0


def test_token_files(odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in ROWS))
    want, start = [], 0
    for i, t in rows:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.token_digests(odd).collect()) == sorted(want)
    assert token_files.token_digests(odd.limit(0)).count() == 0


def test_token_ranges(spark, docs, tmp_path):
    """Any range of the whole collection, over images and parts; ranges beyond it; an empty collection."""
    resolve = token_files.public_tokenizer("byte_bpe_50k.json")
    tok = token_files.encoder(resolve()).tok
    path = token_files.write_token_files(docs.filter("doc_id < 60"), resolve, str(tmp_path / "files"), image_tokens=2000)
    whole = [i for r in docs.filter("doc_id < 60").orderBy("doc_id").collect() for i in [*tok.encode(r.text, add_special_tokens=False).ids, 0]]
    n = len(whole)
    for a, b in ((0, n), (0, 1), (n - 1, n + 50), (1999, 2001), (n // 3, n // 2), (5, 5), (n, n + 9)):
        assert token_files.read_range(spark, path, a, b).tolist() == whole[a:b]
    none = token_files.write_token_files(docs.limit(0), resolve, str(tmp_path / "none"))
    assert token_files.read_range(spark, none, 0, 9).tolist() == []


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    image = token_files.Image(token_files.write_image([4, 5, 6], [3, 0, 1000], ids, bits, 64))
    assert (image.ids(0, 1003) == ids).all() and (image.ids(100, 301) == ids[100:301]).all() and len(image.doc(1)) == 0


def test_pre_tokens_match_the_library():
    import random

    enc = token_files.encoder(token_files.public_tokenizer("byte_bpe_50k.json")())
    random.seed(2)
    parts = ["a", "é", "'s", "'", "'re", " ", "  ", "\n", "1", "²", "!", "日", "<|endoftext|>", "don't", " '"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(2000)]
    ids, n = enc.encode(texts)
    for x, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True):
        assert x.tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_sharding(spark, docs, odd):
    """Exact shard sizes and gapless slots, digests of every row against Python, and the same answer again."""
    many = spark.range(0, 30_000, 1, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))  # most partitions hold ten rows
    for rows in (docs, odd, odd.limit(0), many, many.limit(5)):
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), "rows", None) for r in rows.collect())
        made = sharding.digests(rows).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in made) == want
        slots: dict[int, list[int]] = {}
        for r in made:
            slots.setdefault(r.shard, []).append(r.slot)
        sizes = [len(slots.get(s, ())) for s in range(24)]
        assert sum(sizes) == len(made) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert "other" in sharding.shuffle_into_shards(docs.withColumns({"other": F.lit(1), "slot": F.lit("x")})).columns
    key = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows.collect())
    assert key(sharding.shuffle_into_shards(docs)) == key(sharding.shuffle_into_shards(docs)) != key(sharding.shuffle_into_shards(docs, seed=5))


def test_sharding_bounds(spark):
    """A small bound on the matrix puts partitions together; a task's run of slots doesn't depend on the partitions."""
    many = spark.range(0, 20_000, 1, 1500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    made = sharding.shuffle_into_shards(many, 8, bin_rows=100, cells=400)
    bins = made.groupBy("shard", F.floor(F.col("slot") / 100).alias("b")).count().collect()
    assert len(bins) == 8 * 25 and {r["count"] for r in bins} == {100}
    rows = made.collect()
    assert len({r.doc_id for r in rows}) == 20_000
    for s in range(8):  # neighbours in the input aren't neighbours in a shard, and no half of a shard prefers early rows
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert sum(abs(a[1] - b[1]) < 10 for a, b in zip(own, own[1:])) < 30
        assert abs(np.mean([d for _, d in own[:1250]]) - 10_000) < 700
    matrix = sharding.communication_matrix([5, 0, 9, 7], sharding.shard_sizes(21, 4), 1)
    assert matrix.sum(axis=1).tolist() == [5, 0, 9, 7] and matrix.sum(axis=0).tolist() == sharding.shard_sizes(21, 4)


@pytest.mark.parametrize(("good", "bad", "n"), [(300, 700, 200), (40, 9000, 2000), (500, 500, 900)])
def test_large_draws(monkeypatch, good, bad, n):
    """The draw for numbers beyond numpy's, with small numbers: its mean, variance and bounds."""
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)
    draw, total = np.random.default_rng(3), good + bad
    got = np.array([sharding._hypergeometric(draw, good, bad, n) for _ in range(20_000)])
    variance = n * good / total * bad / total * (total - n) / (total - 1)
    assert abs(got.mean() - n * good / total) < 4 * np.sqrt(variance / len(got)) and abs(got.var() / variance - 1) < 0.05
    matrix = sharding.communication_matrix([50, 0, 70], [40, 40, 40], 1)
    assert matrix.sum(axis=0).tolist() == [40, 40, 40] and matrix.sum(axis=1).tolist() == [50, 0, 70]
    monkeypatch.undo()
    assert abs(sharding._hypergeometric(draw, 4 * 10**9, 6 * 10**9, 10**9) - 4 * 10**8) < 10**5


def sketch_of(units):
    """The printed sketch of a set of paragraphs, in Python."""
    import base64

    import xxhash

    cells = [[0, 0, 0] for _ in range(24)]
    for u in units:
        d = xxhash.xxh64(u.encode(), seed=42).intdigest()
        check = xxhash.xxh64(d.to_bytes(8, "little"), seed=42).intdigest()
        for j in range(3):
            cell = cells[8 * j + (d >> 6 * j & 7)]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ d, cell[2] ^ check
    return base64.b64encode(b"".join(n.to_bytes(2, "big") + k.to_bytes(8, "big") + h.to_bytes(8, "big") for n, k, h in cells)).decode()


def test_hot_ids(spark):
    """Rows of one id follow each other by text hash, over many ranges; every row has one successor and is one."""
    rows = spark.createDataFrame([(7 if k % 3 else k, f"text {k}.\nline {k}") for k in range(600)], "doc_id long, text string")
    made = fingerprints.with_next(rows, "doc_id", "text").select("id", "text", "next", F.xxhash64("text").alias("h")).collect()
    order = sorted(made, key=lambda r: (-r.id, -r.h))
    assert [r.next for r in order] == [r.text for r in order[1:]] + [order[0].text]


def test_fingerprints(spark, docs, odd):
    split = lambda s: {x for x in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", s) if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in fingerprints.versions(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    for i, d in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)].text, len(d.text)
        edited = d.text[: n - n // 3] + after[: n // 3]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(split(d.text), split(edited))) < 1e-9 and abs(r.near_next - like(split(d.text), split(after))) < 1e-9
    for part in (docs.filter("doc_id < 80"), odd):  # the columns of fingerprints: equal texts, and sketches made in Python
        shown = {}
        for r in fingerprints.versions(part.withColumn("doc_id", F.xxhash64("text", "doc_id"))).join(part.select(F.xxhash64("text", "doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id").collect():
            assert shown.setdefault(r.t, r.fingerprint) == r.fingerprint
        assert len(set(shown.values())) == len({frozenset(split(t)) for t in shown})
        for t, mark in shown.items():
            assert mark == sketch_of(split(t))
    assert fingerprints.versions(odd).count() == len(ROWS) and fingerprints.versions(odd.limit(0)).count() == 0
    assert fingerprints.versions(odd.filter("doc_id = 5")).first().near_next == 1.0


def test_leaks(spark, odd):
    bench = spark.createDataFrame([("a", "two three"), ("a", "SIX seven rest"), ("b", None), ("c", " ".join(f"q{k}" for k in range(20))), ("d", "dolor")], "item_id string, text string")
    whole = {r.doc_id: r for r in decontaminate.report(odd, bench).collect()}
    assert (whole[3].n_words, whole[3].n_hit, whole[3].n_items, whole[3].contaminated) == (8, 5, 1, True) and whole[5].n_hit == 3000 and whole[1].n_words == 0
    parts = decontaminate.find_leaks(odd, bench, ["doc_id"], block_bytes=1)
    assert {r.doc_id: (r.n, r.i) for r in parts.select("doc_id", decontaminate.n_hit().alias("n"), F.size(F.coalesce("__leak_items", F.array())).alias("i")).collect()} == {k: (r.n_hit, r.n_items) for k, r in whole.items()}
    named = spark.createDataFrame([(None, "two three"), ("null", "four five")], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(odd, named).collect()}[3] == (4, 1)
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "7", "None"]
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == len(ROWS) and decontaminate.report(odd.limit(0), bench).count() == 0


def test_affected_documents(spark):
    """Whoever holds a whole window goes, however long the text; parts of windows and short items' words don't count."""
    passage = " ".join(f"p{k}" for k in range(30))
    long_ = " ".join(f"w{k}" for k in range(5000))
    bench = spark.createDataFrame([("a", passage), ("b", "just eight words make one short whole item"), ("c", "two words")], "item_id string, text string")
    rows = [
        (1, passage, False), (2, f"{long_} {passage}", False), (3, f"{long_} {' '.join(passage.split()[7:20])} {long_}", False), (4, f"{long_}\n{passage.upper().replace(' ', ', ')}", False),
        (5, f"{long_} {' '.join(passage.split()[7:19])} {long_}", True), (6, long_, True), (7, f"{long_} just eight words make one short whole item", False), (8, f"{long_} two words {long_}", True), (9, None, True), (10, "two words", False),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 1):
        found = decontaminate.find_leaks(docs, bench, docs.columns, block_bytes=block)
        assert {r.doc_id for r in found.filter(~decontaminate.affected()).collect()} == {i for i, _, stays in rows if stays}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {i for i, _, stays in rows if stays}
    assert {r.doc_id for r in decontaminate.decontaminate(docs.withColumnRenamed("text", "__leak_text"), bench, "__leak_text").collect()} == {i for i, _, stays in rows if stays}


def test_pipeline(spark, docs):
    import corpus_pipeline

    toxic = {r.doc_id for r in queries.op3_toxicity(spark, SF).filter("toxic").collect()}
    first = docs.filter(~F.col("doc_id").isin(list(toxic)))
    heads = {r.class_id for r in jaccard_join.similarity_links(first).collect()}
    leaks = {r.doc_id for r in queries.op10_decontamination(spark, SF).filter("n_hit > 0").collect()}  # all items have a window's words
    before = set(store.names(spark, f"{store.shared_dir(spark)}/arbora"))
    got = corpus_pipeline.run(spark, SF)
    assert len(set(store.names(spark, f"{store.shared_dir(spark)}/arbora")) - before) == 1  # the result
    assert {r.doc_id for r in got.collect()} == heads - leaks and got.columns == [*docs.columns, "ids"]


def test_pipeline_edges(spark, odd, tmp_path):
    """Empty tables, nulls, repeated rows and no labels: every stage has a result, with all columns."""
    import corpus_pipeline

    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven rest")], "item_id long, text string")
    for name, parts, kept in (("full", (odd, labels.limit(0), bench.limit(0)), ["1", "2", "3", "5", "7", "None"]), ("leak", (odd, labels.limit(0), bench), ["1", "2", "5", "7", "None"]), ("none", (odd.limit(0), labels, bench), [])):
        for table, rows in zip(("documents", "labels", "benchmark"), parts, strict=True):
            rows.drop("ids").write.parquet(str(tmp_path / name / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert sorted(str(r.doc_id) for r in got.collect()) == kept and got.columns == [*odd.drop("ids").columns, "ids"]
