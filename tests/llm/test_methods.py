"""Operators where they are hard: crowded buckets, changed splits, very common passages, odd characters, long words."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe, common, decontaminate, exact_dedup, secrets, simhash, suffix_dedup, token_count, token_store, toxicity, vocab
from tests.llm.test_operators import base_spans, brute_removed, components, multiset, prose

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


# ---- near-duplicates


def exact_roots(texts, similarity=0.8):
    sets = [set(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist()) for t in texts]
    return components(range(len(sets)), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


def test_near_duplicates_inside_a_crowd(spark):
    # a core that all share: other pairs have a similarity of 0.74, the true ones 0.83
    core = " ".join(f"c{k}" for k in range(340))
    texts = []
    for k in range(150):
        own = [f"d{k}w{j}" for j in range(60)]
        for c in range(2):
            texts.append(" ".join([core, *own[:25], *(f"{w}x{c}" for w in own[25:])]))
    random.Random(1).shuffle(texts)
    want = set(exact_roots(texts).values())
    assert len(want) == 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_chained_through_an_original(spark):
    r = random.Random(2)
    original = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(60):  # each like the original, not like each other
        edited = list(original)
        for j in r.sample(range(5, 290, 5), 6):
            edited[j] = f"e{k}n{j}"
        texts.append(" ".join(edited))
    texts.insert(40, " ".join(original))
    root = exact_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x.doc_id for x in simhash.near_duplicates(docs).collect()} == set(root.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_crowd_pairs_lose_none(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "PROBES", 16)
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(50):
        base = [r.choice(pool) for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(pool)
            texts.append(" ".join(copy))
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "row bigint, text binary")
    none = spark.createDataFrame([], "row bigint, root bigint")
    got = {(x.a, x.b) for x in simhash.crowd_pairs(rows, none, 5, 0.8).collect()}
    sets = [set(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist()) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= got and len(got) < len(sets) ** 2 / 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_near_duplicates_equal_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, set(simhash.shingle_hashes(simhash.words_of((r.text or "").encode()), 5).tolist())) for r in docs.collect()]
    met: dict = {}
    for k, (_, x) in enumerate(rows):
        for h in x:
            met.setdefault(h, []).append(k)
    pairs = {(a, b) for held in met.values() for i, a in enumerate(held) for b in held[i + 1 :]}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    empty = [i for i, x in rows if not x]
    alike = [(rows[a][0], rows[b][0]) for a, b in pairs if len(rows[a][1] & rows[b][1]) >= 0.8 * len(rows[a][1] | rows[b][1])] + list(zip(empty, empty[1:]))
    for a, b in alike:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {i for i in up if root(i) == i}
    got = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(want) < len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_ranks_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1 and toxic is not null").select("score", "toxic").toPandas()
    rank = got["score"].rank()
    pos, n = got["toxic"].sum(), len(got)
    area = (rank[got["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert area >= 0.95


def test_rows_are_named_alike_whatever_the_splits(spark, tmp_path):
    rows = [(k % 40, prose(k % 37, 40), "x" * (k % 50)) for k in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, wide string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert common.is_scan(docs) and common.is_scan(docs.where("doc_id > 3").select("doc_id", "text"))
    assert not common.is_scan(docs.repartition("doc_id")) and not common.is_scan(docs.where(F.rand() > 0.5)) and not common.is_scan(docs.limit(3))
    listed = docs.select(*common.place(docs), "doc_id").where("doc_id % 3 = 0").withColumn("row", F.col("doc_id") * 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        picked = common.pick_rows(docs, listed, True, "row")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # the second scan is cut otherwise than the first
        got = picked.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert multiset((r.doc_id, r.row) for r in got) == multiset((i, i * 7) for i, _, _ in rows if i % 3 == 0)
    assert common.pick_rows(docs, listed.limit(0), False).count() == 400


def test_duplicates_below_an_exchange(spark, tmp_path):
    """Rows below a shuffle come in another order each time: they are written first."""
    rows = [(k, prose(k % 100, 30), "y" * 2000) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, wide string").repartition(64, "doc_id")
    assert sorted(r.doc_id for r in exact_dedup.keep_rows(docs).collect()) == list(range(100))
    assert sorted(r.doc_id for r in simhash.near_duplicates(docs).collect()) == list(range(100))


def test_spread_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "PLAIN_ROWS", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 5")
    got = common.join_spread(left, right, ["k"], "n")
    assert got.columns == ["k", "v", "n", "m"]
    assert multiset(map(tuple, got.collect())) == multiset(map(tuple, left.join(right, "k").collect()))


# ---- suffix arrays


def brute_lpf(contexts, doc, places):
    """By definition: the longest prefix that starts, at one of the places, in a context of a smaller document."""
    texts = [bytes(c).rstrip(b"\xff") for c in contexts]
    out = np.zeros((len(texts), places), int)
    whole = lambda c, k: 0xFF not in c[k : k + 50].tolist()
    for i in range(len(texts)):
        for k in range(places):
            if not whole(contexts[i], k):
                continue
            a = texts[i][k:]
            for j in range(len(texts)):
                for m in range(places) if doc[j] < doc[i] else ():
                    if whole(contexts[j], m):
                        b, n = texts[j][m:], 0
                        while n < min(len(a), len(b)) and a[n] == b[n]:
                            n += 1
                        out[i, k] = max(out[i, k], n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_longest_previous_factors(seed):
    r = np.random.default_rng(seed)
    contexts = r.integers(97, [98, 99, 100, 120][seed], (24, suffix_dedup.WIDTH)).astype(np.uint8)
    contexts[8:16, 10:] = contexts[:8, 10:]  # passages that others have too, from a place inside
    contexts[16:20, :60] = contexts[4:8, :60]
    contexts[3, 62:] = contexts[9, 55:] = contexts[20, 66:] = 0xFF  # texts that end
    contexts[5, :4] = 0xFF  # one that begins
    doc = r.integers(0, 12, 24)
    got = suffix_dedup.longest_previous(contexts, doc)
    assert got.tolist() == brute_lpf(contexts, doc, suffix_dedup.SIDE + 1).tolist()
    strings = np.ascontiguousarray(contexts[:, :50])
    assert suffix_dedup.longest_previous(strings, doc, 1).tolist() == brute_lpf(strings, doc, 1).tolist()


@pytest.fixture(scope="module")
def passages():
    r = random.Random(8)
    shared = [prose(700 + k, 25) for k in range(4)]
    rows = []
    for k in range(160):
        parts = [prose(2000 + k, r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared[: 1 + k % 4])
            low = r.randrange(0, len(p) // 2)
            parts += [p[low : low + r.randint(30, len(p))], prose(3000 + r.randrange(90), r.randint(0, 8))]
        rows.append((None if k == 70 else k // 2 if k < 20 else 500 - k, " ".join(parts)))
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 19, 10_000, 2_000), (900, 200, 5, 2_000), (900, 200, 50, 1), (2000, 1 << 19, 10_000, 3)])
def test_suffix_dedup_in_chunks_pieces_slices_and_split_anchors(spark, passages, sizes):
    docs = spark.createDataFrame(passages, "doc_id bigint, text string").repartition(3).transform(common.materialize)
    got = suffix_dedup.remove_repeats(docs, sizes=suffix_dedup.Sizes(*sizes)).collect()
    assert multiset((r.doc_id, bytes(r.kept)) for r in got) == multiset(brute_removed(passages, 50))


def test_suffix_dedup_notices_changed_partitions():
    one = [(0, 1, prose(1, 40).encode()), (1, 2, prose(2, 40).encode())]
    a, b = suffix_dedup.Chunk(one), suffix_dedup.Chunk([(0, 2, one[1][2]), (1, 1, one[0][2])])
    assert len(a.e_hash) == len(b.e_hash) and a.checksum() != b.checksum()
    codes = suffix_dedup._pack(np.zeros(len(a.e_hash), np.uint8))[:4] + np.zeros(-(-len(a.e_hash) // 4), np.uint8).tobytes()
    told = {0: [(0, codes, a.checksum())]}
    assert len(suffix_dedup._codes_of(told, 0, a)) == len(a.e_hash)
    with pytest.raises(RuntimeError):
        suffix_dedup._codes_of(told, 0, b)


# ---- tokens


def test_front_ends_cut_every_known_character_as_the_library():
    for path in (BYTE, WORD):
        v = vocab.vocab(path)
        for low, high in vocab.KNOWN:
            for c in map(chr, range(low, high + 1)):
                text = f"a{c}b {c}{c} 1{c}.{c}{c.upper()} {c}é"
                if v.normal(text) is not None:
                    assert v.pieces(text) == v._ask(text), hex(ord(c))


def test_ids_and_counts_of_odd_texts_as_the_library():
    from tokenizers import Tokenizer

    r = random.Random(1)
    known = [chr(c) for low, high in vocab.KNOWN for c in range(low, high + 1)]
    odd = [chr(c) for c in (*range(0x300, 0x370), *range(0x530, 0x600), *range(0x2080, 0x20A0), 0xA7CB, 0xA7DC, 0x1100, 0x1161, 0x11A8, 0x3099, 0x212B, 0xFB01, 0x1D400, 0x10400, 0xE000)]
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    count, store, exact = token_count.counter(WORD), token_store.library_encoder(WORD), bpe.encoder(BYTE)
    for _ in range(4000):
        pool = r.choice([known, odd, [*"ab 'slltedm09.\n\t\x1c\x85\xa0"], known + odd])
        x = "".join(r.choices(pool, k=r.randint(0, 30)))
        if r.random() < 0.1:
            x += "<|endoftext|>" + x
        ids = word.encode(x, add_special_tokens=False).ids
        assert count.count(x) == len(ids), x
        assert np.frombuffer(store.encode(x), "<u4").tolist() == ids, x
        assert np.frombuffer(exact.encode(x), "<u4").tolist() == byte.encode(x, add_special_tokens=False).ids, x


def test_ids_of_a_column_as_the_library():
    from tokenizers import Tokenizer

    r = random.Random(3)
    known = [chr(c) for low, high in vocab.KNOWN for c in range(low, high + 1)]
    latin = [*"abcdefst' '' 'S'Ll'reMve 0123.,!$<|>()\t\n\x0b\x0c\r\x00\x1b\x1c\x1f\x7f", *map(chr, range(0x80, 0x260)), *"\xd7\xf7\xb5\u0130\u2019\u201c\u201d\u2014\u20ac\xa0\x85"]
    library, store = Tokenizer.from_file(WORD), token_store.LibraryEncoder(WORD)
    texts = [f"a{c}b {c}{c}. '{c}s{c}'ll 1{c},{c} {c}" for c in map(chr, [*range(0x530), *range(0x1E00, 0x2100), *range(0x2FF0, 0x3040)])]
    texts += ["", None, " ", "'", "''s", "it's 'tis'", "\xd7", "a\xd7b", "<|endoftext|>", "x<|startoftext|>'s", "\u0130 \u0130b", "é" * 300, "ab'" * 100, "\u3000", *[None] * 3]
    odd = [chr(c) for c in (*range(0x300, 0x370), *range(0x530, 0x600), *range(0x2080, 0x20A0), 0xA7CB, 0xA7DC, 0x1100, 0x1161, 0x11A8, 0x3099, 0x212B, 0xFB01, 0x1D400, 0x10400, 0xE000, 0x3A3, 0x1680, 0x2028)]
    pools = [latin, latin[:50], known + latin, odd + latin[:50], odd + known, [*"aeIs'. !\u0130\u0301\u0307\u0323"]]
    texts += ["".join(r.choices(r.choice(pools), k=r.randint(0, 40))) for _ in range(12000)]
    r.shuffle(texts)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.array([None, "not asked", *texts])[2:]
    texts += ["", None, "", "  ", "\t"]
    want += [[]] * 5
    column = pa.concat_arrays([column, pa.array(texts[-5:])])
    for low, high in ((0, len(texts)), (5, 5), (7, 8), (100, 900), (len(texts) - 5, len(texts) - 2), (len(texts) - 2, len(texts))):
        ids, sizes = store.encode_all(column[low:high])
        assert len(sizes) == high - low and sizes.sum() == len(ids)
        for k, got in enumerate(np.split(ids, np.cumsum(sizes))[:-1]):
            assert got.tolist() == want[low + k], ascii(texts[low + k])


def test_parts_of_a_column_are_looked_up_once(monkeypatch):
    store, asked = token_store.LibraryEncoder(WORD), []
    real = store.words.all
    monkeypatch.setattr(store.words, "all", lambda keys: (asked.extend(keys), real(keys))[1])
    store.encode_all(pa.array(["Some words, some marks! And words... (some) 11 words' \xe9t\xe9," * 20] * 30))
    assert len(asked) == len(set(asked)) < 30


def test_words_of_other_scripts_are_looked_up_once(monkeypatch):
    store, one = token_store.LibraryEncoder(WORD), []
    monkeypatch.setattr(store, "encode", one.append)
    ids, sizes = store.encode_all(pa.array(["\u0441\u043b\u043e\u0432\u043e \u201cword\u201d. \u4e00\u4e8c e\u0301"] * 3))
    assert not one and len(set(sizes.tolist())) == 1 and sizes.sum() == len(ids) > 0
    store.encode_all(pa.array(["\u4e00\u4e8c\u3002" * 20, "\u4e00\u3002"]))
    assert max(map(len, store.words)) < 40 and {"\u4e00\u4e8c", "\u3002"} <= store.memo.keys()  # no sentences
    for low, high in vocab.KNOWN:  # so that letters alone are one pre-token
        for c in map(chr, range(low, high + 1)):
            assert not store.v.normal(c).isalpha() or store.v._ask(c) == [store.v.normal(c)], hex(ord(c))


def test_shards_end_with_the_document_that_fills_them(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 50)
    monkeypatch.setattr(token_store, "LOOKUP_BYTES", 300)
    r = random.Random(6)
    rows = [(k, r.choice([None, "", " ".join(r.choices(["one", "two's", "\u201cthree\u201d.", "fi\xe9"], k=r.randint(0, 120)))])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    folder = common.shared_dir(spark)
    manifest = token_store.write_shards(docs, WORD, 2, folder)
    store, want = token_store.library_encoder(WORD), {}
    ids = {k: [*np.frombuffer(store.encode(x or ""), "<u4").tolist(), 2] for k, x in rows}
    assert {x.id: np.frombuffer(x.ids, "<u4").tolist() for x in token_store.read_shards(manifest, folder, 2).collect()} == ids
    for x in manifest.orderBy("part", "seq").collect():
        held = token_store.Shard(common.get_file(folder, x.name))
        want.setdefault(x.part, []).append((x.docs, x.ids, len(held.doc_ids), int(held.sizes.sum()), int(held.sizes[-1])))
    assert sum(n for shards in want.values() for n, *_ in shards) == 300
    for shards in want.values():
        assert all(docs == here and n == total for docs, n, here, total, _ in shards)
        assert all(n >= 50 > n - last for _, n, _, _, last in shards[:-1])
        assert shards[-1][1] - shards[-1][4] < 50


def test_long_words_take_no_square_of_their_length():
    from tokenizers import Tokenizer

    r = random.Random(4)
    x = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    started = time.process_time()
    assert token_count.counter(WORD).count(x) == len(Tokenizer.from_file(WORD).encode(x, add_special_tokens=False).ids)
    assert time.process_time() - started < 20
    assert len(token_count.counter(WORD).memo) < 2 * token_count.MEMO and x not in token_count.counter(WORD).memo


# ---- leaks


def test_leaks_of_short_and_edited_items():
    filler = " zzz yyy xxx " * 30
    items = [(k, prose(400 + k, 12 + k) + "? " + prose(500 + k, 3 + k % 4).replace(".", "")) for k in range(12)]
    shorts = [(50, "Why? Because the sky is blue today"), (51, "How so? Yes indeed"), (52, "Paris"), (53, "Who? Me, of course, my dear")]
    index = decontaminate.Index(items + shorts)
    for i, text in items:
        words = text.split()
        edits = [" ".join([*words[:k], "changedword", *words[k + 1 :]]) for k in range(len(words))]
        edits += [" ".join(words[:k] + words[k + 1 :]) for k in range(len(words))]
        for text, found in zip(edits, index.leaks([filler + e + filler for e in edits])):
            assert i in [x["item_id"] for x in found], text
    for i, text in shorts:
        assert [x["item_id"] for x in index.leaks([filler + text + filler])[0]] == [i]
    assert index.leaks([filler, "because the moon is red", "", "indeed yes"]) == [[], [], [], []]


def test_leaks_against_brute_force(spark):
    """Whole items in texts of many passages, and texts without."""
    r = random.Random(3)
    items = [(k, " ".join(f"i{k}w{j % 50} of" for j in range(r.randint(4, 40)))) for k in range(40)] + [(40, " ".join(f"long{j}" for j in range(700)))]
    texts, want = [], []
    for d in range(120):
        parts, here = [" ".join(f"u{d}x{j}" for j in range(r.randint(0, 300)))], set()
        for _ in range(r.randint(0, 2)):
            i, t = r.choice(items)
            parts += [t, " ".join(f"v{d}x{j}" for j in range(r.randint(0, 200)))]
            here.add(i)
        texts.append((d, " ".join(parts)))
        want.append((d, sorted(here)))
    docs, table = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((x.doc_id, sorted(m.item_id for m in x.leaks)) for x in decontaminate.find_leaks(docs, table).collect())
    assert got == want


def test_large_test_sets_are_cut_into_several_indexes(spark, monkeypatch):
    items = [(k, prose(8000 + k, 30)) for k in range(50)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 9000)
    assert len(list(decontaminate.indexes(table))) > 1
    docs = spark.createDataFrame(items, "doc_id bigint, text string")
    assert all(x.doc_id in [m.item_id for m in x.leaks] for x in decontaminate.find_leaks(docs, table).collect())


# ---- tries and secrets


@pytest.mark.parametrize("budget", [2_000, 40_000, 1 << 30])
def test_tries_of_long_common_prefixes(budget):
    import hashlib

    r = random.Random(6)
    stem = bytes(r.choices(b"xyz", k=10_000))
    keys = [stem[: r.choice([10_000, 9_000, 300])] + bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(700)] + [b"", stem]
    want = {}
    trie = exact_dedup.PatriciaTrie(budget)
    for n, k in enumerate(keys):
        i, rows = want.get(k, (n, 0))
        want[k] = (min(i, n), rows + 1)
        trie.insert(k, (n, 1, hashlib.sha256(k).digest()))
    got = [(k, o[:2]) for k, o in trie.owners()]
    assert len(got) == len(want) and dict(got) == want


def test_secrets_of_a_text_with_very_many(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("0123456789abcdef", k=26)) + "zé"[: k % 3] for k in range(n)) for n in (1, 127, 128, 129, 400, 100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    started = time.time()
    got = {x.doc_id: [tuple(s) for s in x.base] for x in secrets.find_secrets(docs).collect()}
    assert time.time() - started < 60
    assert got == {k: base_spans(t) for k, t in enumerate(texts)}


def test_compression_counts_only_where_a_round_changed_something(monkeypatch):
    r = np.random.default_rng(7)
    ids = np.minimum(r.zipf(1.3, 60_000), 3000).astype(np.uint32)
    ids[::500] = 9999
    counted, real = [], token_store._bounds
    monkeypatch.setattr(token_store, "_bounds", lambda left, right: (counted.append(len(left)), real(left, right))[1])
    symbols, rules = token_store.repair(ids, 10_000, 9999)
    assert token_store.expand(symbols, rules, 10_000).tolist() == ids.tolist()
    assert len(counted) > 4 and sum(counted) <= len(ids) + 2 * (len(ids) - len(symbols))


def test_expansions_of_rules_in_a_chain_take_no_square():
    n = 3000  # each rule adds one id to the one before: written down they'd take 4.5 million
    rules = np.array([[0, 1], *([1000 + k, k % 7] for k in range(n - 1))], np.uint32)
    want = [0, 1, *(k % 7 for k in range(n - 1))]
    for symbols in ([999 + n], [999 + n, 5, 1000], [1000, 1000], [3], []):
        got = token_store.expand(np.array(symbols, np.uint32), rules, 1000)
        assert got.dtype == np.uint32 and got.tolist() == [x for s in symbols for x in (want[: s - 998] if s >= 1000 else [s])]
