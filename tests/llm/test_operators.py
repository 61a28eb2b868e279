"""Each operator against a brute-force version, a library, a round trip or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from colbrook.llm import chat_tree, common, decontam, exact_dedup, html_crf, lm_score, queries, simhash, sp_unigram, token_count, toxicity_fm, url_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, fp long"


def texts(seed=0, n=60):
    r = random.Random(seed)
    words = ["the", "of", "Étre", "idiot", "and", "ner.", "a", "zu", "漢字", "x|y", "don't", "12,5"] + ["w%d" % i for i in range(40)]
    out = [None, "", " \n\t", "a", "a b", "<|endoftext|> a<|endoftext|>", "x" * 3000, "▁ ▁▁", "a  b   c \u00a0 d", "\x1c\x85 a"]
    for _ in range(n):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(r.choice([2, 5, 9, 40, 200]))))
    out += out[10:16]
    t = out[20].split(" ")
    out += [" ".join(t), "  ".join(t), " ".join(t[:-2] + ["zz"])]
    return out


def docs_of(spark, rows, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 1, 0.5, "d", 3) for i, t in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return docs_of(spark, texts())


def test_exact_dedup_matches_brute_force(spark, documents):
    rows = documents.unionByName(documents.limit(30)).unionByName(docs_of(spark, ["a b"] * 50 + ["ab "], 500)).unionByName(spark.createDataFrame([(None, "ab", None, None, None, None, None, None)], DOCS))
    data = [(r.doc_id, r.text or "") for r in rows.collect()]
    for k in (2, 1000):
        got = exact_dedup.exact_dedup(rows, k).collect()
        assert len(got) == len(data)
        groups = defaultdict(list)
        for d, t in data:
            groups[hashlib.sha256(t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))).encode()).hexdigest()].append((-len(t), d is None, d or 0, d))
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
        for r in got:
            g = groups[r.text_sha256]
            assert r.group_size == len(g) and r.keep_id == min(g)[3]
        kept = exact_dedup.drop_exact_copies(rows, k)
        assert kept.columns == rows.columns and kept.count() == len(groups)


def test_misra_gries_finds_every_heavy_key():
    r = np.random.default_rng(1)
    keys = r.zipf(1.3, 20_000) % 5000
    summary, counts = np.array([]), np.array([], np.int64)
    for part in np.array_split(keys, 17):
        u, c = np.unique(part, return_counts=True)
        summary, counts = exact_dedup.mg_merge(np.concatenate([summary, u]), np.concatenate([counts, c]), 20)
    u, c = np.unique(keys, return_counts=True)
    assert len(summary) <= 20 and set(u[c > len(keys) / 20]) <= set(summary)


def test_heavy_digests_are_few_and_all_found(spark):
    r = np.random.default_rng(2)
    keys = [f"d{x}" for x in r.zipf(1.3, 30_000) % 5000]
    count = Counter(keys)
    digests = spark.createDataFrame([(x,) for x in keys], "digest string").repartition(9)
    for k in (5, 50, 1000):
        found = {x.digest for x in exact_dedup.heavy_hitters(digests, len(keys), k).collect()}
        assert len(found) <= k and {d for d, n in count.items() if n > 2 * len(keys) / (k + 1)} <= found
    assert [exact_dedup.counters(n) for n in (0, 10**6, 10**9, 10**12)] == [1000, 1000, 20_000, 100_000]


def test_ids_of_text_sort_as_text(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "x  y"), ("c", "z")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).collect()} == {("b", None, False), ("a", None, False), (None, None, True), ("c", "c", True)}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect() if r.doc_id != "a"} == {("b", "b"), (None, "b"), ("c", "c")}
    assert {r.doc_id for r in simhash.drop_near_copies(rows).collect()} == {"a", "b", "c"}


def test_token_counts_equal_the_library(documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in token_count.count_tokens(documents, path, limit=20).collect()}
    for d in documents.collect():
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes, rows[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 20), d.text


def test_token_counts_on_driver_documents(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = queries.op4_token_counts(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_tokens == len(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)


def test_proven_set_is_whole():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    v = token_count.Vocabulary(open(path, encoding="utf-8").read())
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    assert len(v.whole) > 40_000
    counter = token_count.Counter(v)
    for t in r.sample(sorted(v.whole), 2000):
        if counter.find(t) == [t]:
            assert len(library.encode(t, add_special_tokens=False).ids) == 1
    assert v._merged_long([bytes([b]) for b in "überhaupt nicht the end".encode()]) == v.merged("überhaupt nicht the end".encode())


def test_url_rules_match_brute_force(spark):
    rules = [*queries.URL_RULES, ("block", "a.b.example.net/en/x"), ("allow", "example.net/en/x/y"), ("block", "ads.org")]
    r = random.Random(2)
    urls = [None, "", "net/", "http://", "http://net", "x://NET/", "http://a.net?x=/en/", "http://example.net.org/fr", "http://.net/", "http://net./a"]
    for _ in range(400):
        host = ".".join(r.choice(["a", "b", "example", "net", "org", "com", "ads", "WWW"]) for _ in range(r.randint(1, 4)))
        urls.append(f"http://{host}" + "".join(r.choice(["/", "/en", "/fr/", "/de/", "/x", "/xy", "?q", "#en/", "y"]) for _ in range(r.randint(0, 4))))
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for limit in (1 << 20, 25):
        got = {x.page_id: x for x in url_trie.filter_urls(pages, rules, limit=limit).collect()}
        for i, u in enumerate(urls):
            host, path = url_trie.split_url(u)
            best = None
            for action, rule in rules:
                h, slash, p = rule.partition("/")
                if (host == h or host.endswith("." + h)) and (not slash or path.startswith("/" + p)):
                    key = (h.count("."), len(slash + p))
                    best = max(best, (key, action, rule)) if best else (key, action, rule)
            assert (got[i].host, got[i].path) == (host, path)
            assert (got[i].rule, got[i].verdict) == ((best[2], best[1]) if best else (None, "allow")), u


def test_long_urls_and_repeated_rows(spark):
    long = "http://example.net/en/" + "a/" * 500_000
    rows = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "x." * 200_000 + "net/")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, len(r.path)) for r in url_trie.filter_urls(rows, queries.URL_RULES).collect()) == [(1, "example.net/en/", 1_000_004), (1, "example.net/en/", 1_000_004), (2, "net/", 1)]


def test_chat_round_trip_and_sharing(spark):
    rows = []
    for c in range(40):
        said = [("system", "<|im_end|> be <||brief<"), ("user", f"q{c % 3}\\n"), ("assistant", f"<|a {c % 2}\n"), ("assistant\nx\\", None)][: 1 + c % 4]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(said)]
    rows += [(100, 0, None, None), (100, 0, "user", "b"), (100, None, "user", "a"), (None, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", queries.F.lit(1))
    packs = chat_tree.build_packs(df, max_leaves=7)
    found = {r.conv_id: r for r in chat_tree.read_back(packs).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (found[c].n_turns, found[c].loss_chars, found[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    one = chat_tree.Pack()
    one.add(1, [("user", "a"), ("assistant", "b")])
    one.add(2, [("user", "a"), ("assistant", "c")])
    row = one.row()
    assert row["text"].count("user") == 1 and [n["position"] for n in row["nodes"]] == [0, len(chat_tree.render("user", "a")[0])] * 1 + [len(chat_tree.render("user", "a")[0])]
    assert len(row["nodes"][2]["attention"]) == 4


def test_shared_turns_are_emitted_once_a_pack(spark):
    """Seventeen shared turns and two branches of two turns; then one first turn that all share."""
    said = [("user" if i % 2 == 0 else "assistant", f"turn {i} " * 9) for i in range(17)]
    rows = [(c, i, r, t) for c in range(40) for i, (r, t) in enumerate([*said, ("user", f"branch {c % 2}"), ("assistant", f"end {c % 2}")])]
    schema = "conv_id long, turn long, role string, text string"
    packs = chat_tree.build_packs(spark.createDataFrame(rows, schema))
    many = packs.count()
    found = packs.selectExpr("size(nodes) AS n", "size(leaves) AS leaves").collect()
    # Every task that has conversations emits the shared turns once: 21 nodes in all in one task.
    assert sum(p.leaves for p in found) == 40 and sum(p.n for p in found) <= 19 * many + 2
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = chat_tree.build_packs(spark.createDataFrame(rows, schema)).selectExpr("size(nodes) AS n", "size(leaves) AS leaves").collect()
        assert [tuple(p) for p in one] == [(21, 40)]
        rows = [(c, i, r, t) for c in range(2000) for i, (r, t) in enumerate([("user", "the first turn"), ("assistant", f"answer {c} " + "x" * 300)])]
        wide = chat_tree.build_packs(spark.createDataFrame(rows, schema), max_symbols=1 << 18)
        packs = wide.collect()
        size = sum(len(p.text) for p in packs)
        assert sum(p.text.count("the first turn") for p in packs) == len(packs) <= 1 + size // (1 << 18) and sum(len(p.leaves) for p in packs) == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_every_symbol_has_a_position_and_long_conversations_format(spark):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"{'ab'[c % 2 if i > 2 else 0]}{i}" * (1 + i % 5)) for c in range(6) for i in range(30 + c)]
    rows += [(9, 0, "assistant", "long <|im_end|> \n" * 100_000)]
    packs = chat_tree.with_positions(chat_tree.build_packs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    seen = 0
    for p in packs.collect():
        assert len(p.positions) == len(p.owner) == len(p.text)
        for leaf in p.leaves:
            a = p.nodes[leaf.node].attention
            at = [i for x, y in zip(a[::2], a[1::2]) for i in range(x, y)]
            assert [p.positions[i] for i in at] == list(range(len(at)))
            want = "".join(chat_tree.render(r, t)[0] for c, _, r, t in rows if c == leaf.conv_id)
            assert "".join(p.text[i] for i in at) == want and p.owner[at[-1]] == leaf.node
            seen += 1
    assert seen == 7


def brute_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, documents):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    fp = {r.doc_id: brute_fingerprint(r.text, 4) for r in documents.collect()}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{v:016x}" for d, v in fp.items()}
    assert {d: r.component_id for d, r in got.items()} == {d: find(d) for d in fp}
    kept = simhash.drop_near_copies(documents)
    assert {r.doc_id for r in kept.collect()} == {find(d) for d in fp} and kept.columns == documents.columns


@pytest.mark.parametrize("size", [1, 3])
def test_bk_trees_and_cut_shards_lose_no_link(spark, size):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (25, size), dtype=np.uint64)
    flips = [base.copy() for _ in range(20)]
    for f in flips:
        f[np.arange(25), r.integers(0, size, 25)] ^= np.uint64(1) << r.integers(0, 64, 25).astype(np.uint64)
    values = np.unique(np.concatenate([*flips, base]), axis=0)
    near = np.bitwise_count(values[:, None] ^ values[None]).sum(2) <= 2
    shard = np.arange(len(values)) % 3
    pairs = {(int(a), int(b)) for q, v in simhash.BKForest(values, shard).search(values, shard, 2, room=50) for a, b in zip(q, v)}
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (shard[:, None] == shard[None])))}
    nodes = spark.createDataFrame([(bytearray(v.tobytes()), i) for i, v in enumerate(values)], "fp binary, rep long")
    root = simhash.forest(len(values), [np.nonzero(near)])
    for cut in (3, 1000):
        found = {x.node: x.root for x in simhash.components(simhash.links_of(nodes, simhash.Settings(size=size, radius=2), shard=cut)).collect()}
        assert {i: found.get(i, i) for i in range(len(values))} == dict(enumerate(root.tolist()))


@pytest.mark.parametrize("count", [10**5, 10**7, 10**9, 10**12])
def test_span_keys_lose_no_link_at_any_size(count):
    r = np.random.default_rng(7)
    a = r.integers(0, 1 << 63, (3000, 1), dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b[k * 700 :, 0] ^= np.uint64(1) << r.integers(0, 64, len(b) - k * 700).astype(np.uint64)
    chosen = simhash.key_bits(simhash.Settings(), count)
    assert (simhash.shard_keys(a, chosen) == simhash.shard_keys(b, chosen)).any(axis=1).all()
    assert len(chosen) <= 126


def test_pairs_looked_at_per_fingerprint_stay_flat():
    """Of random fingerprints: the rows of each one's shards, over all keys."""
    r = np.random.default_rng(9)
    looked = []
    for count in (10**5, 10**6):
        fp = r.integers(0, 1 << 63, (count, 1), dtype=np.uint64) << np.uint64(1)
        looked.append(0.0)
        for key in simhash.key_bits(simhash.Settings(), count):
            size = np.unique(simhash.shard_keys(fp, [key]), return_counts=True)[1]
            looked[-1] += float((size.astype(float) ** 2).sum()) / count
    assert looked[1] < 1.5 * looked[0] < 400


def test_wide_fingerprints_find_similar_texts(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, group = [], []
    for g in range(60):
        own = [word() for _ in range(300)]
        for _ in range(3):
            copy = own[:]
            for k in r.sample(range(300), 3 if g < 40 else 60):
                copy[k] = word()
            rows.append(" ".join(copy))
            group.append(g)
    settings = simhash.Settings.for_similarity(0.8)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs_of(spark, rows), settings).collect()}
    same = [got[3 * g] == got[3 * g + 1] == got[3 * g + 2] for g in range(60)]
    assert sum(same[:40]) >= 39 and not any(same[40:])
    assert all(group[d] == group[c] for d, c in got.items())
    # Which rows stay is decided by true similarity among these candidates.
    sets = [shingles(t) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash.forest(len(rows), [tuple(np.array(x) for x in zip(*links))])
    assert {x.doc_id for x in simhash.drop_near_copies(docs_of(spark, rows), settings).collect()} == set(root.tolist())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_by_true_similarity(spark, monkeypatch):
    """Pairs under 0.8 stay, whatever their fingerprints' distance; whole and cut components."""
    r = random.Random(11)
    rows = []
    for g in range(90):
        own = ["w%d" % r.randrange(10**6) for _ in range(200)]
        # One block of new words: similarity (196 - k - 4) / (196 + k + 4), from 0.9 down to 0.65.
        k = 6 + g % 30
        rows += [" ".join(own), " ".join(own[:50] + ["z%d" % r.randrange(10**6) for _ in range(k)] + own[50 + k :])]
    own = ["w%d" % r.randrange(10**6) for _ in range(150)]
    rows += [" ".join(own[:i] + ["v%d" % i] + own[i + 1 :]) for i in range(0, 60, 3)]
    sets = [shingles(t) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash.forest(len(rows), [tuple(np.array(x) for x in zip(*links))])
    want = set(root.tolist())
    for piece in (simhash.PIECE, 6):
        monkeypatch.setattr(simhash, "PIECE", piece)
        got = {x.doc_id for x in simhash.drop_near_copies(docs_of(spark, rows), simhash.Settings.for_similarity(0.8)).collect()}
        assert want <= got and len(got - want) <= 2


def test_near_stage_on_driver_documents_by_true_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, shingles(r.text or "")) for r in docs.collect())
    links = [(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if len(a & b) >= 0.8 * len(a | b)]
    root = simhash.forest(len(rows), [tuple(np.array(x) for x in zip(*links))])
    got = {x.doc_id for x in simhash.drop_near_copies(docs, simhash.Settings.for_similarity(0.8)).collect()}
    assert got == {rows[i][0] for i in set(root.tolist())}


def test_short_texts_of_similarity_just_enough_are_linked(spark):
    """Eight words against the same eight plus one: similarity of 4 in 5 shingles."""
    rows = []
    for g in range(40):
        own = ["w%d" % (100 * g + i) for i in range(9)]
        rows += [" ".join(own[:8]), " ".join(own)]
    got = {x.doc_id for x in simhash.drop_near_copies(docs_of(spark, rows), simhash.Settings.for_similarity(0.8)).collect()}
    assert got == set(range(0, 80, 2))


@pytest.mark.parametrize("count", [10**5, 10**7, 10**9])
def test_sampled_keys_reach_the_target_recall_at_any_size(count):
    s = simhash.Settings.for_similarity(0.8)
    bits, radius = 64 * s.size, s.reach
    chosen = simhash.key_bits(simhash.replace(s, radius=radius), count)
    r = np.random.default_rng(5)
    differ = r.random((2000, bits)) < simhash.differing(0.8)
    met = np.zeros(len(differ), bool)
    for at in chosen:
        met |= ~differ[:, at].any(axis=1)
    assert (met & (differ.sum(axis=1) <= radius)).mean() >= s.recall - 0.01


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    found = {x.node: x.root for x in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_matches_brute_force(spark, documents, order):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in documents.collect()]
    train = [w for d, w in rows if zlib.crc32(str(d).encode()) % 10]
    count = Counter()
    for w in train:
        w = ["<s>", *w]
        for k in range(1, order + 1):
            count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = sum(len(w) for w in train)
    norm = total + 0.1 * (len({k for k in count if len(k) == 1}) - 1 + 1)
    got = {r.doc_id: r for r in lm_score.held_out_scores(documents, order=order, block_tokens=500).collect()}
    assert len(got) == len(rows)
    for d, w in rows:
        base = score = 0.0
        full = ["<s>", *w]
        for i in range(1, len(full)):
            p = (count[(full[i],)] + 0.1) / norm
            base += math.log10(p)
            for k in range(1, order):
                h = tuple(full[i - k : i]) if i - k >= 0 else None
                if h:
                    p = (count[(*h, full[i])] + lm_score.prior(lm_score.MU, k) * p) / (count[h] + lm_score.prior(lm_score.MU, k))
            score += math.log10(p)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[(x,)] > 0 for x in w), total)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_state_is_carried_through_lanes(order):
    """Lanes of any length give what one lane a text gives, and a plain walk with failure arcs too."""
    r = np.random.default_rng(order)
    sizes = r.integers(2, 60, 40)
    starts = np.cumsum(sizes) - sizes
    flat = r.integers(2, 9, int(sizes.sum()))
    flat[starts], flat[np.append(starts[1:], len(flat)) - 1] = 0, 1
    hashes = lm_score.mix64(np.arange(9, dtype=np.uint64))
    learn = np.repeat(np.arange(40) % 2 == 0, sizes)
    grams, counts, by_gram = [], [], Counter()
    for at, h in lm_score.ngrams(hashes[flat], starts, order, 60):
        rank, n = lm_score.numbered(h)
        grams.append((at, rank))
        counts.append(np.bincount(rank, weights=learn[at], minlength=n))
        for i in at[learn[at]]:
            by_gram[tuple(flat[i - len(grams) + 1 : i + 1].tolist())] += 1
    automaton = lm_score.BackoffAutomaton(grams, counts, len(flat), 500, 7)
    whole = automaton.traverse(starts, lane=10**6)
    for lane in (1, 7, 64):
        assert np.allclose(automaton.traverse(starts, lane), whole, rtol=1e-13)

    def p(gram):
        if len(gram) == 1:
            return (by_gram[gram] + 0.1) / (500 + 0.1 * 8)
        m = lm_score.prior(lm_score.MU, len(gram) - 1)
        return (by_gram[gram] + m * p(gram[1:])) / (by_gram[gram[:-1]] + m)

    for a, n in zip(starts.tolist(), sizes.tolist()):
        history = (0,) if order > 1 else ()
        for i in range(a + 1, a + n):
            want, gram = 0.0, (*history, int(flat[i]))
            while len(gram) > 1 and not by_gram[gram]:
                m = lm_score.prior(lm_score.MU, len(gram) - 1)
                want += math.log10(m / (by_gram[gram[:-1]] + m)) if by_gram[gram[:-1]] else 0.0
                gram = gram[1:]
            assert math.isclose(whole[i], want + math.log10(p(gram)), rel_tol=1e-12)
            history = (*history, int(flat[i]))[-(order - 1) :] if order > 1 else ()


def test_lm_messages_follow_the_input():
    """One message a block and shard, none empty: never more than there are n-grams, whatever the shards."""
    r = np.random.default_rng(3)
    for shards in (8, 400, 50_000):
        for words in (30, 3000):
            sizes = np.array([words // 2, words - words // 2])
            flat = r.integers(0, 500, words).astype(np.uint32)
            ids = [pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["id"])]
            block = lm_score.Block(5, ids, flat, lm_score.mix64(np.arange(500, dtype=np.uint64)), sizes, np.array([True, False]))
            sent = lm_score.messages(block, 3, shards, 60)
            keys = sum(int(lm_score._unpack(x[3], "<u8")[:3].sum()) for x in sent)
            assert len(sent) == len({x[0] for x in sent}) <= min(shards, keys) and keys <= 3 * words
            assert all(lm_score._unpack(x[3], "<u8")[:3].sum() for x in sent) and len(lm_score.own_row(block)) == 1


def test_lm_is_a_distribution_and_beats_the_base(spark):
    rows = queries.op1_lm_scoring(spark, SF).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_sentencepiece_round_trip_and_best_score(spark, documents):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sp_unigram.PieceModel(open(path, "rb").read())
    encoder = sp_unigram.Encoder(model)
    pieces = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] in (1, 4)}

    def best(text):
        """Plain quadratic search over all pieces."""
        text = "▁" + text.replace(" ", "▁")
        score = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - 20), j):
                if text[i:j] in pieces:
                    score[j] = max(score[j], score[i] + model.scores[pieces[text[i:j]]])
            if text[j - 1] not in pieces:
                score[j] = max(score[j], score[j - 1] + model.unknown)
        return score[-1]

    for r in documents.collect():
        text = r.text or ""
        ids = np.frombuffer(encoder.encode(text), "<i4").tolist()
        if "▁" not in text:
            assert model.decode(ids) == text
        if text and len(text) < 800:
            got, i = 0.0, 0
            while i < len(ids):
                if model.kinds[ids[i]] == sp_unigram.BYTE:
                    first = int(model.pieces[ids[i]][3:5], 16)
                    i += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                    got += model.unknown
                else:
                    got += model.scores[ids[i]]
                    i += 1
            assert math.isclose(got, best(text)), text
    encoded = sp_unigram.encode(documents, path)
    back = {r.doc_id: r.text for r in sp_unigram.decode(encoded, path).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in documents.collect() if "▁" not in (r.text or ""))
    digests = {r.doc_id: r for r in sp_unigram.encode_digest(documents, path).collect()}
    assert all(digests[r.doc_id].n_pieces == len(r.pieces) for r in encoded.collect())


def test_long_unspaced_text_encodes_in_linear_time():
    import time

    model = sp_unigram.PieceModel(open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read())
    r = random.Random(5)
    text = "".join(r.choice("漢字的是不了人在有我他这中大来上") for _ in range(1_700_000))
    assert len(text.encode()) > 5_000_000
    began = time.process_time()
    ids = np.frombuffer(sp_unigram.Encoder(model).encode(text), "<i4").tolist()
    assert time.process_time() - began < 120 and model.decode(ids) == text
    one = sp_unigram.MARK + text[:30_000]
    assert len(one.encode()) > sp_unigram.LONG_UNIT
    long, sp_unigram.LONG_UNIT = sp_unigram.LONG_UNIT, 1 << 40
    try:
        plain = model.segment(one)
    finally:
        sp_unigram.LONG_UNIT = long
    assert model.segment(one) == plain


def brute_leaks(text, item, rate=0.2):
    a, b = item.lower().encode().split(), text.lower().encode().split()
    if not a:
        return False
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= int(rate * len(a) + 1e-9)


def test_decontamination_against_exact_search(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + r.choice(["", "ly", "ing"])
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 10, 15, 23, 30, 30, 44, 55)] + ["", None]
    docs = [None, "", "ax"]
    for cut in (0, 3, 6):
        # Short documents before and after one that holds only a part of an item.
        docs += ["ax", " ".join(items[8].split()[cut:]), "by", "ax", " ".join(items[10].split()[: 44 - cut]), "az"]
    for _ in range(160):
        left, right = ([word() for _ in range(r.choice([0, 3, 50]))] for _ in range(2))
        own = r.choice(items[3:12]).split()
        for _ in range(r.randint(0, int(0.3 * len(own)))):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], [word(), word()], [word()]])
        docs.append(" ".join(left + own + right))
    df = docs_of(spark, docs)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(df, bench).collect()}
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if brute_leaks(t or "", x or "")}
    assert got <= want
    assert len(got) >= 0.98 * len(want)
    clean = decontam.drop_leaking(df, bench)
    assert {x.doc_id for x in clean.collect()} == set(range(len(docs))) - {d for d, _ in got} and clean.columns == df.columns


def edited_leaks(n, edits, kind, before, after, trials=100):
    """Items of n random words, and for each a document that holds it after this many edits."""
    r = random.Random(n * 1000 + edits)
    word = lambda: "w%d" % r.randrange(10**6)
    items, docs = [], []
    for _ in range(trials):
        item = [word() for _ in range(n)]
        own = item[:]
        for _ in range(edits):
            k = r.randrange(len(own))
            own[k : k + 1] = {"delete": [], "insert": [own[k], word()], "substitute": [word()]}[kind]
        items.append(" ".join(item))
        docs.append(" ".join([word() for _ in range(before)] + own + [word() for _ in range(after)]))
    return items, docs


def recall_of(items, docs):
    found = {(d, i) for d, i, _, _ in decontam.Items([(i, t.encode()) for i, t in enumerate(items)]).find([t.encode() for t in docs])}
    want = {(d, d) for d in range(len(docs)) if brute_leaks(docs[d], items[d])}
    assert found <= want and len(want) == len(docs)
    return len(found) / len(want)


@pytest.mark.parametrize("before", [0, 60])
@pytest.mark.parametrize("n, edits", [(25, 5), (40, 8), (59, 5)])
def test_passages_with_deleted_words_at_the_documents_end(n, edits, before):
    """The passage ends the document, or is all of it; the windows run past the end."""
    assert recall_of(*edited_leaks(n, edits, "delete", before, 0)) >= 0.9


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute"])
@pytest.mark.parametrize("n", [16, 32, 50, 64, 100, 128, 200])
def test_recall_holds_at_every_item_length(n, kind):
    """All allowed edits, in mid-document and as the whole document; small samples, so one or two may miss."""
    for before, after in ((60, 60), (0, 0)):
        assert recall_of(*edited_leaks(n, n // 5, kind, before, after, 50)) >= decontam.RECALL - 0.03


def test_toxicity_held_out(spark):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    p = rows.join(labels, "doc_id").toPandas()
    assert rows.count() == 1000 and p.score.between(0, 1).all()
    assert (p[~p.held_out].predicted == p[~p.held_out].toxic).mean() > 0.97
    assert (p[p.held_out].predicted == p[p.held_out].toxic).mean() > 0.9


def test_toxicity_training_is_bounded_whatever_repeats(spark):
    """One labelled id that 100,000 documents have, and a very long text, within max_rows."""
    many = spark.range(100_000).selectExpr("7L AS doc_id", "concat('the idiot ', id % 9) AS text")
    few = spark.createDataFrame([(1, "a nice day"), (2, "w " * 500_000 + "nice")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (1, 0), (2, 0), (3, 5), (4, None)], "doc_id long, toxic int")
    fitted = []
    keep = toxicity_fm.FactorizationMachine.fit_chosen
    toxicity_fm.FactorizationMachine.fit_chosen = lambda self, rows, y, chosen: fitted.append((rows, y)) or keep(self, rows, y, chosen)
    try:
        model = toxicity_fm.train(many.unionByName(few), labels, max_rows=50)
        small = toxicity_fm.train(few, labels)
    finally:
        toxicity_fm.FactorizationMachine.fit_chosen = keep
    assert len(fitted[0][0]) == len(fitted[0][1]) == 50 and all(len(t) <= toxicity_fm.FEATURES for t in fitted[0][0])
    assert len(fitted[1][0]) == 2 and 0 < small.score([]) < 0.5 and 0 <= model.score([]) <= 1


def test_terms_are_chosen_alike_here_and_on_executors(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity_fm.train(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "toxic").collect()
    terms = [np.array(sorted({t for w in (r.text or "").encode().lower().split() for t in toxicity_fm.terms_of(w)}), np.int32) for r in rows]
    here = toxicity_fm.FactorizationMachine(steps=1).fit(terms, np.array([r.toxic for r in rows]))
    assert len(set(here.slots) ^ set(model.slots)) <= 0.02 * len(model.slots) and here.w0 == pytest.approx(math.log((sum(r.toxic for r in rows) + 0.5) / (sum(1 - r.toxic for r in rows) + 0.5)), abs=0.2)


def test_factorization_machine_sum_over_all_pairs():
    r = np.random.default_rng(1)
    model = toxicity_fm.FactorizationMachine()
    model.w0, model.w, model.v = -0.3, r.normal(size=12), r.normal(size=(12, 4)) / 3
    for slots in ([], [3], [0, 5], list(range(12)), [1, 2, 9, 11]):
        out = model.w0 + sum(model.w[i] for i in slots) + sum(model.v[i] @ model.v[j] for i in slots for j in slots if i < j)
        assert math.isclose(model.score(slots), 1 / (1 + math.exp(-out)), rel_tol=1e-9)


def test_factorization_machine_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (4000, 12))
    y = (x[:, 0] ^ x[:, 1]).astype(np.int64)
    rows = [np.flatnonzero(v).astype(np.int32) for v in x]
    model = toxicity_fm.FactorizationMachine(steps=600).fit(rows, y)
    hit = np.mean([(model.score([model.slots[i] for i in v if i in model.slots]) >= 0.5) == t for v, t in zip(rows, y)])
    assert hit > 0.95


def test_extraction_of_unseen_pages_and_of_the_driver_pages(spark):
    chain = html_crf.train()
    right = total = 0
    for page, article in html_crf.labelled_pages(120, seed=99):
        blocks = html_crf.leaf_blocks(page)
        want = html_crf.labels_of(blocks, article)
        got = chain.decode(html_crf.features(blocks))
        right += sum(a == b for a, b in zip(want, got))
        total += len(want)
    assert right / total > 0.97
    import re

    for r in queries.op7_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"[ \t\n\x0b\f\r]+", " ", html_crf.html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_viterbi_and_marginals_match_enumeration():
    from itertools import product

    r = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        s, t = np.zeros((n, 2)), r.normal(0, 2, (2, 2))
        s[:, 1] = r.normal(0, 2, n)
        score = {y: sum(s[i, y[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=n)}
        fwd, bwd, z = html_crf.forward_backward(s, t)
        total = sum(math.exp(v) for v in score.values())
        assert math.isclose(z, math.log(total), rel_tol=1e-12)
        for i in range(n):
            assert math.isclose(math.exp(fwd[i, 1] + bwd[i, 1] - z), sum(math.exp(v) for y, v in score.items() if y[i]) / total, rel_tol=1e-9)
        chain = html_crf.Chain()
        chain.weights, chain.step = {f"b{i}": float(s[i, 1]) for i in range(n)}, t.tolist()
        assert tuple(chain.decode([[f"b{i}"] for i in range(n)])) == max(score, key=score.get)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep" + "</div>" * 100_000, "".join(f"<div class='n{i}'>t" for i in range(30_000)), "<p>x</q>" * 50_000, "<!" * 200_000, "<a " * 200_000, "<a \"'>" * 50_001,
        "<script>" + "</script " * 50_000, "<b title='" * 50_000 + ">", "<" * 300_000, "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 100_000, "&" * 200_000, "<a '>\"" * 40_001 + "x>",
    ],
)
def test_hostile_pages_take_linear_time_and_memory(page):
    import time
    import tracemalloc

    chain = html_crf.Chain()
    chain.weights = {f"in={x}": 0.1 for x in ("div", "p")} | {"bias": 1.0} | {f"named=n{i}": 0.1 for i in range(20)}
    began = time.process_time()
    tracemalloc.start()
    text = html_crf.main_text(chain, page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - began < 20 and peak < 400 * len(page)
    assert ("deep" in text) == ("deep" in page)


def test_pages_with_defects(spark):
    pages = [None, "", "plain text only", "<p>unclosed <b>bold", "<!-- never closed <p>x", "<script>var a='</p>'", "<div class='a>b'><p>x &amp; y&nbsp;z &lt;", "<<>>< p>", "<a href=\"x\">" * 50, "<p>" + "long " * 50_000 + "</p>"]
    df = spark.createDataFrame([(i, "u", p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_crf.extract(df).collect()}
    assert len(got) == len(pages) and got[0].text == "" and got[1].n_chars == 0
    assert [b[0] for b in html_crf.leaf_blocks("<p>a<br>b <i>c</i>d<p>e<script>x</script> f</p>&eacute;")] == ["a b cd", "e f", "é"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = c.sql(queries.ORACLES[name])
    rows = queries.QUERIES[name](spark, SF)
    assert set(rows.columns) == set(answer.columns)
    assert sorted(map(repr, map(tuple, rows.select(*answer.columns).collect()))) == sorted(map(repr, answer.fetchall()))


def test_empty_tables(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity_fm.train(empty, labels)
    frames = [
        lm_score.held_out_scores(empty), exact_dedup.exact_dedup(empty), exact_dedup.drop_exact_copies(empty), token_count.count_tokens(empty, queries.tokenizer_path("byte_bpe_50k.json")),
        simhash.near_duplicates(empty), simhash.drop_near_copies(empty), sp_unigram.encode(empty, path), decontam.find_leaks(empty, bench), decontam.drop_leaking(empty, bench), toxicity_fm.score_toxicity(empty, model),
        toxicity_fm.drop_toxic(empty, model), chat_tree.read_back(chat_tree.build_packs(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")), url_trie.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert decontam.find_leaks(docs_of(spark, ["a"]), bench).count() == 0
    assert toxicity_fm.score_toxicity(docs_of(spark, ["a", None]), model).count() == 2


def test_pipeline_matches_brute_force(spark):
    """Stage by stage in plain Python on the smallest table; nothing clean goes."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity_fm.Scorer(model)
    left = {d for d, t in rows.items() if scorer.score(t.encode()) < 0.5}
    groups = defaultdict(list)
    for d in left:
        groups["".join(c for c in rows[d] if c not in " \t\n\x0b\x0c\r")].append((-len(rows[d]), d))
    left = {min(g)[1] for g in groups.values()}
    sets = {d: shingles(rows[d]) for d in left}
    order = sorted(sets)
    links = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order[:i]) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = simhash.forest(len(order), [tuple(np.array(x) for x in zip(*links))])
    left = {order[r] for r in set(root.tolist())}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    common = {d: {w for i, t in enumerate(items) for w in [i] if len(set(t.lower().split()) & set(rows[d].lower().split())) >= 0.6 * len(set(t.split()))} for d in left}
    left = {d for d in left if not any(brute_leaks(rows[d], items[i]) for i in common[d])}
    encoder = sp_unigram.Encoder(sp_unigram.PieceModel(open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()))
    out = corpus_pipeline.run(spark, SF)
    got = {r.doc_id: r.pieces for r in out.collect()}
    assert out.columns == ["doc_id", "pieces", "round_trip"] and set(got) == left and 0 < len(left) < len(rows)
    assert all(r.round_trip == ("▁" not in rows[r.doc_id]) for r in out.collect())
    assert all(got[d] == np.frombuffer(encoder.encode(rows[d]), "<i4").tolist() for d in left)


def test_pipeline_on_hostile_tables(spark, tmp_path):
    """Empty, null and repeated rows, ids and texts, columns named like its own; and no rows at all."""
    import corpus_pipeline

    names = ["rid", "row", "fp", "component", "order", "data", "pieces", "digest", "score"]
    texts_ = [None, "", "x y z", "the quick brown fox jumps over it " * 3, "ü" * 5000, "b c d e f"]
    rows = [(None if i % 4 == 3 else i % 5, texts_[i % 6], *[f"c{i}"] * len(names)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, part, want in (("full", docs, 4), ("none", docs.limit(0), 0)):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, 0), (1, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "b c d e f"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "pieces", "round_trip"] and out.count() == want
    stage_out = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage_out = common.materialise(f(spark, stage_out, f"{tmp_path}/full"), "stage")
        assert stage_out.columns == docs.columns
    assert stage_out.count() == 4


def test_hostile_tables(spark):
    """Null ids and texts, repeated rows, and columns named like the operators' own."""
    names = "key fp rep piece p o task node root a b data train id shard block kind total distinct digest rid n row keep_id group_size kept score predicted pieces y terms __rid h_digest w".split()
    texts_ = [None, "", "x y z", "x y z", "the idiot " * 3000, "ü" * 5000, "a b c d e f g"]
    rows = [(None if i % 4 == 3 else i % 5, texts_[i % 7], *[f"c{i}"] * len(names)) for i in range(28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "b c d e f", 2.0), (None, "zzz", 1.0), (2, None, 1.0)], "item_id long, text string, distance double")
    labels = spark.createDataFrame([(0, 1, "t"), (1, 0, "t"), (None, 1, "t"), (2, None, "t"), (3, 0, None)], "doc_id long, toxic int, text string")
    model = toxicity_fm.train(docs, labels)
    bpe, piece = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    whole = [lm_score.held_out_scores(docs), exact_dedup.exact_dedup(docs), token_count.count_tokens(docs, bpe), simhash.near_duplicates(docs), sp_unigram.encode(docs, piece), sp_unigram.encode_digest(docs, piece), toxicity_fm.score_toxicity(docs, model)]
    assert [f.count() for f in whole] == [28] * len(whole)
    assert exact_dedup.drop_exact_copies(docs).count() == 5
    near = simhash.drop_near_copies(docs)
    assert near.count() == 5 and near.columns == docs.columns
    leaks = decontam.find_leaks(docs, bench).collect()
    assert {r.item_id for r in leaks} == {1} and len(leaks) == 4
    assert decontam.drop_leaking(docs, bench).count() == 24 and toxicity_fm.drop_toxic(docs, model).columns == docs.columns


def test_whole_rows_survive_when_all_columns_are_null(spark):
    docs = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, extra string")
    assert exact_dedup.drop_exact_copies(docs).count() == 1 and simhash.drop_near_copies(docs).count() == 1
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None] * 3
    assert lm_score.held_out_scores(docs).count() == 3
    chats = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat_tree.read_back(chat_tree.build_packs(chats)).collect()] == [2]
    pages = spark.createDataFrame([(None, None, None)] * 2, "page_id long, url string, html string")
    assert html_crf.extract(pages).count() == 2 and url_trie.filter_urls(pages, queries.URL_RULES).count() == 2
