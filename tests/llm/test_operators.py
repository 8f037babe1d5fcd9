"""Operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import differences, duck
from pyspark.sql import functions as F

from quirewise.llm import bpe, html, langid, lm, minhash, near, packing, simhash, toxicity, urls
from quirewise.llm.components import components
from quirewise.llm.queries import ORACLES, QUERIES
from quirewise.llm.words import words_in_repeated_runs

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, ROOT), con, ORACLES[name]) == []


@pytest.mark.parametrize("length", [2, 3, 5, 8])
def test_words_in_repeated_runs(spark, length):
    rng = random.Random(length)
    cases = [[rng.choice("ab" if i % 2 else "abcdef") for _ in range(rng.randrange(0, 60))] for i in range(80)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, w array<string>")
    got = {r.i: r.n for r in df.select("i", words_in_repeated_runs(F.col("w"), length).alias("n")).collect()}
    for i, words in enumerate(cases):
        runs = [tuple(words[j : j + length]) for j in range(len(words) - length + 1)]
        count = Counter(runs)
        assert got[i] == len({j + k for j, r in enumerate(runs) if count[r] > 1 for k in range(length)}), words


def _jaccard(a, b):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_fingerprints_against_sets(documents, texts):
    got = {r.doc_id: r for r in minhash.fingerprints(documents).collect()}
    ids = sorted(texts, reverse=True)
    off = []
    for i, doc_id in enumerate(ids):
        text, after = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [row.near_edited - _jaccard(text, edited), row.near_next - _jaccard(text, after)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04
    by_text = {}
    for doc_id, text in texts.items():
        assert by_text.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint


def test_next_rows_are_spread_however_the_ids_lie(spark):
    ids = [*range(3000), *range(10**12, 10**12 + 1000), 2**62, -(2**62)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = minhash.with_next(df, cells=64).withColumn("p", F.spark_partition_id()).select("doc_id", "next_text", "p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(Counter(r.p for r in got).values()) < len(ids) / 2
    down = sorted(ids, reverse=True)
    assert {r.doc_id: r.next_text for r in got} == {a: f"text {b}" for a, b in zip(down, down[1:] + down[:1])}


def test_densification_against_a_plain_search(spark):
    rng = random.Random(4)
    cases = [[rng.getrandbits(63) - 2**62 << 1 for _ in range(n)] for n in (1, 2, 5, 40, 130, 300, 3000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, h array<bigint>")
    got = {r.i: r.v for r in df.select("i", minhash.densified(minhash.bin_values(F.col("h"))).alias("v")).collect()}
    rest = 64 - minhash.BIN_BITS
    for i, hashes in enumerate(cases):
        least = {}
        for h in hashes:
            b, value = (h >> rest) + minhash.BINS // 2, h & (1 << rest) - 1
            least[b] = min(value, least.get(b, value))
        want = []
        for b in range(minhash.BINS):
            at, t = b, 0
            while at not in least:
                at = (minhash._STARTS[b] + t * minhash._STEPS[b]) % minhash.BINS
                t += 1
            want.append(least[at])
        assert got[i] == want


def test_bpe_equals_the_public_library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    cases = ["", "a", "aaaa" * 900, " " * 3000 + "x", "<|endoftext|> it's", "\x1c\x85 \u3000d", "\U0001f600é" * 400, "ǅ٣½ 123\r\n"]
    cases += ["".join(rng.choice("abAB 's\n\t0é\U0001f600ß") for _ in range(rng.randrange(1, 80))) for _ in range(500)]
    for text, ids in zip(cases, own.encode(cases)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_main_text():
    page = (
        "<html><head><title>no</title><style>no</style></head><body><nav><a href=x>no</a></nav><header>no</header>"
        "<div class='cookie-notice'>no</div><article><h1>Head</h1><p>One &lt;b&gt; &nbsp; two<br>three<p><b>four</b>five"
        "<aside>no</aside><script>var t='</p>no';</script><!-- no --><form><p>no</form>"
        "<section id=comments><p>no</p></section></article><footer>&copy; no</footer>"
    )
    assert html.main_text(page) == "Head\n\nOne <b> two three\n\nfourfive"
    plain = "<p>" + "the story of the day and of the night is told in it " * 4 + "</p><p>short</p><p>" + "and it was as good as it was for the rest of us " * 4
    assert html.main_text(plain + "</p><p><a href=x>links only, a row of them</a></p>").count("\n\n") == 2
    assert html.main_text("<p>a</p>") == "a" and html.main_text(None) == html.main_text("") == ""


def test_main_text_with_misleading_articles():
    story = "the story of the day and of the night is told in it " * 4
    said = "and it was as good as it was for the rest of us " * 3
    want = story.strip()
    comments = f"<section class=comments><article><p>{said}</article><article>me too</article></section>"
    assert html.main_text(f"<div id=content>{story}</div>{comments}") == want
    assert html.main_text(f"<div id=content>{story}</div><article class='comment first'>{said}</article>") == want
    assert html.main_text(f"<aside><article>{said}</article></aside><p>{story}</p>") == want
    assert html.main_text(f"<article><h1>Head</h1><p>{story}</article>{comments}") == f"Head\n\n{want}"
    cards = "<article><a href=x>Card</a></article>" * 3
    assert html.main_text(f"<h1>Head</h1><p>{story}</p><p>short</p><p>{story}</p>{cards}") == f"Head\n\n{want}\n\nshort\n\n{want}"
    outside = html.main_text(f"<p>Posted today</p><article><p>{story}</p><p>{story}</article><p>{said}</p><p>no</p>")
    assert outside == f"{want}\n\n{want}\n\n{said.strip()}"


def test_main_text_behind_raw_elements_without_an_end():
    story = "the story of the day and of the night is told in it " * 4
    for raw in ("<svg viewBox='0 0 1 1'/>", "<math/>", "<svg>", "<canvas id=a>", "<iframe src=x>", "<object>"):
        assert html.main_text(f"<article>{raw}<p>{story}</article>") == story.strip(), raw
    two = f"<article><svg a='1'/><p>{story}</p><svg><title>no</title></svg><p>{story}</article>"
    assert html.main_text(two) == f"{story.strip()}\n\n{story.strip()}"
    assert html.main_text(f"<article><p>{story}</p><script>var a = '{story}'") == story.strip()


def _brute_rule(host, path):
    best = None
    for kind, at, under in urls.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(under) and (best is None or len(at + under) > len(best[0])):
            best = (at + under, kind)
    return best or (None, None)


def test_url_rules_and_regression(spark):
    hosts = ["example.net", "a.example.net", "notexample.net", "org", "x.org", "example.com", "www.example.com", "net"]
    paths = ["", "/", "/en/", "/en", "/fr/1", "/de/2", "/en/x?q=/de/", "#/fr/"]
    cases = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    cases += [(900, "https://casino-bonus.example.org/en/1"), (901, "https://www.city-garden.example.org/en/1")]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(cases, "page_id int, url string")).collect()}
    for i, url in cases:
        host, path = re.match(r".*?://([^/?#]*)([^?#]*)", url).groups()
        rule, kind = _brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (kind or ("block" if got[i].unwanted >= urls.BLOCK_FROM else "allow"))
    assert (got[900].verdict, got[901].verdict) == ("block", "allow")
    with pytest.raises(ValueError, match="at most"):
        urls.weights(spark.range(2000).selectExpr("concat('http://', id) AS url", "id % 2 AS unwanted"))


@pytest.mark.parametrize("chunk", [1 << 14, 8 << 20])
def test_lm_counts(documents, texts, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm, "CHUNK_KEYS", 200_000)
    got = lm.scored(documents).collect()
    assert len(got) == len(texts)
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    rest = {i: zlib.crc32(str(i).encode()) % 10 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if rest[i] for w in ws)
    n, types = sum(counts.values()), len(counts)
    for row in got:
        words = tokens[row.doc_id]
        assert row.held_out == (rest[row.doc_id] == 0) and row.train_tokens == n and row.n_tokens == len(words)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (types + 1))) for w in words)
        assert row.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_weights_and_chances():
    events = np.array([(b, two, one, 5.0) for b in (1, 3) for two in (0.0, 0.5, 0.25) for one in (0.01, 0.001)])
    mix = lm.weights(events, 99)
    assert np.allclose(mix.sum(1), 1) and (mix >= 0).all() and mix[0, 0] == 0

    def likelihood(m):
        return sum(n * math.log(m[int(b)] @ [two, one, 0.01]) for b, two, one, n in events)

    assert all(likelihood(mix) >= likelihood(np.tile(w, (lm.CONTEXTS, 1))) - 1e-6 for w in ([0.4, 0.4, 0.2], [0.6, 0.3, 0.1], [0.2, 0.2, 0.6]))


def _brute_simhash(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_of_texts(texts):
    for text in [*list(texts.values())[:60], "", "one", "ONE two", " a\x0bb\tC d "]:
        assert simhash.simhash(text) == _brute_simhash(text)


def test_ring_links_find_every_near_pair(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        changed = rng.choice(prints)
        for _ in range(rng.randrange(1, 6)):
            changed ^= 1 << rng.randrange(64)
        prints.append(changed)
    prints = sorted(set(prints))
    rows = [(simhash._signed(p), i) for i, p in enumerate(prints)]
    links = simhash._ring_links(spark.createDataFrame(rows, "fp bigint, node bigint"))
    got = {r.node: r.root for r in components(links).collect()}
    want = _brute_groups(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: got.get(i, i) for i in want} == want


def test_hot_keys_are_linked_in_bounded_runs(spark):
    """Chains whose neighbours only are near: no row stands for another, and no task may hold them all."""
    chains = [(c * 1000 + i, c * 10_000 + i) for c in range(3) for i in range(150)]
    rows = [(0, 7, node, fp) for node, fp in chains] + [(1, 7, node, fp) for node, fp in chains[:20]]

    def near_in(table):
        k, key, fp = (table[c].to_numpy() for c in ("k", "key", "fp"))
        assert max(Counter(zip(k.tolist(), key.tolist())).values()) <= 64
        return lambda a, b: abs(fp[a] - fp[b]) <= 1

    links = simhash.links_by_key(spark.createDataFrame(rows, "k int, key bigint, node bigint, fp bigint"), near_in, held=32)
    got = {r.node: r.root for r in components(links).collect()}
    assert {n: got.get(n, n) for n, _ in chains} == {n: n // 1000 * 1000 for n, _ in chains}


def test_a_run_is_left_as_soon_as_it_is_one_part():
    turns = []

    def near(a, b):
        turns.append(len(a))
        return np.ones(len(a), bool)

    one, _ = simhash._links(np.zeros(500, int), np.zeros(500, int), near)
    assert len(one) == 499 and turns == [499]


def test_near_copies_are_the_same_in_short_runs(spark, monkeypatch):
    """One template with other numbers; the groups do not hang on the rows that a task may hold."""
    rng = random.Random(12)
    base = [f"word{i}" for i in range(200)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice((1, 2, 4, 6))):
            words[rng.randrange(200)] = f"{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").cache()
    want = sorted(r.doc_id for r in near.one_of_each(df).collect())
    monkeypatch.setattr(simhash, "HELD", 16)
    assert sorted(r.doc_id for r in near.one_of_each(df).collect()) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(5, 5), (None, 3), (500, 200)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = {(a, b) for a, b in edges if a is not None and a != b}
    nodes = sorted({n for e in real for n in e})
    assert {n: got.get(n, n) for n in nodes} == _brute_groups(nodes, lambda a, b: (a, b) in real or (b, a) in real)


def test_near_copies(spark, texts):
    rng = random.Random(9)
    base = max(texts.values(), key=len)[:6000].split()
    docs = [(0, " ".join(base))]
    for i in range(1, 30):
        words = list(base)
        for _ in range(rng.choice((1, 3, 8))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, t) for i, t in enumerate(list(texts.values())[:40])]
    got = {r.doc_id for r in near.one_of_each(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    by_id = dict(docs)
    want = _brute_groups(
        list(by_id),
        lambda a, b: by_id[a] == by_id[b]
        or (simhash.simhash(by_id[a]) ^ simhash.simhash(by_id[b])).bit_count() <= 3
        or _jaccard(lower(by_id[a]), lower(by_id[b])) >= 0.8,
    )
    assert got == set(want.values())


def _brute_fit(sizes, costs):
    bins, order = [], []
    for i, size in enumerate(sizes):
        fits = [(b["room"], j) for j, b in enumerate(bins) if b["room"] >= size]
        if fits:
            room = min(fits)[0]
            j = next(b for b in reversed(order) if bins[b]["room"] == room)
        else:
            prices = [(costs[c] / min(c, size + sum(s for s in sizes[i + 1 :] if s <= c - size)), -c) for c in costs if c >= size]
            bins.append({"room": -min(prices)[1], "held": []})
            j = len(bins) - 1
        bins[j]["room"] -= size
        bins[j]["held"].append(size)
        order = [b for b in order if b != j] + [j]
    return [b["held"] for b in bins]


def test_best_fit_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 8193) for _ in range(rng.randrange(1, 120))), reverse=True)
        placed = packing.best_fit(sizes, packing.COSTS)
        held = {}
        for size, (b, offset) in zip(sizes, placed):
            assert offset == sum(held.setdefault(b, []))
            held[b].append(size)
        assert sorted(map(tuple, held.values())) == sorted(map(tuple, _brute_fit(sizes, packing.COSTS)))


def test_packing_covers_every_word(documents, texts):
    got = packing.packed(documents, shard_rows=50).collect()
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        bins.setdefault(r.bin, []).append(r)
    for doc_id, text in texts.items():
        end = 0
        for start, n in sorted(pieces[doc_id]):
            assert start == end
            end += n
        assert end == len(WORD.findall(text)) + 1
    for rows in bins.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.n_tokens
        assert end == rows[0].bin_tokens and rows[0].bin_length == min(c for c in packing.COSTS if c >= end)


def test_codes():
    for n in (2, 3, 4, 7, 9, 20):
        code = langid.codes(n)
        assert code.shape[0] == n and (np.abs(code.sum(0)) < n).all()
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.judged(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.ambiguous for r in got) / len(got) < 0.02


def _brute_segments(values):
    """Maximal scoring segments by their definition: the best first, then the best in what is left on either side."""
    best = max(((sum(values[i:j]), -(j - i), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    left, right = _brute_segments(values[:i]), _brute_segments(values[j:])
    return left + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in right]


def test_segments_against_their_definition():
    rng = random.Random(7)
    for _ in range(150):
        values = [rng.choice((1.3, 2.7, 4.1)) if rng.random() < 0.25 else -0.37 for _ in range(rng.randrange(0, 40))]
        at = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(at, [values[i] for i in at], 0.37)
        want = _brute_segments(values)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


def test_toxicity_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.judged(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.75 and hit / sum(r.predicted for r in got) > 0.85
    text = "A clean start of some words and then you idiot, you stupid moron, such trash and scum again, and so on to the end."
    found = toxicity.scored(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).first()["found"]
    assert found.score > 0.3 and "idiot" in text[found.passages[0].start : found.passages[0].end]


def test_few_labels_rank_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = toxicity.judged(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert above / (len(toxic) * len(clean)) >= 0.75


def test_pipeline(spark, documents, texts):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    left = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, left, ROOT)
        assert kept.columns == documents.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in left.collect()}
        left = kept.cache()
    ids = {r.doc_id for r in left.collect()}
    assert len({texts[i] for i in ids}) == len(ids) > 0.7 * len(texts)
    assert {r.doc_id for r in corpus_pipeline.run(spark, ROOT).collect()} == ids
