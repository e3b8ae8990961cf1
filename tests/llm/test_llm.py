"""The ten operators on small tables with nulls, empty, long and repeated rows, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import decontaminate, language_id, media, packing, sharding, simhash, suffix_dedup, token_output, toxicity, url_filters
from quarrygraph.llm._tokens import default_vocabulary, encoder

DDL = "doc_id long, text string, lang string, source string, n_chars long, run string, fp string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], DDL)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "béta", "Gamma,", "of", "the", "x1", "delta-9", "it's"]
    base = " ".join(rng.choice(words) for _ in range(600))
    made = [(0, None), (1, ""), (2, "   "), (3, base), (4, base), (4, base), (5, base * 20), (6, "123 !!"), (7, "ab" * 300)]
    for i in range(8, 60):
        a = rng.randrange(3000)
        made.append((i, base[a : a + rng.randint(0, 700)] + rng.choice(words) * rng.randint(0, 3)))
    return made


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    for text in ("It's a TEST, naïve café №5 ΣΑΣ", "a<|endoftext|>b", "x y\x85z é 漢字 don't", " \n\t", "İstanbul ﬁ ²"):
        assert encoder(None).ids(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def brute_removed(rows, window=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if data[p : p + window] in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(data[p : p + window])
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{"run_bytes": 4000}, {"run_bytes": 4000, "wide": 1}, {}])
def test_suffix_dedup(spark, rows, sizes):
    assert sorted(tuple(r) for r in suffix_dedup.removal_report(make(spark, rows), **sizes).collect()) == brute_removed(rows)


def test_toxicity(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["good", "day", "sun", "tree"]) for _ in range(20)) + (" awfulword" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    df = make(spark, [*docs, (900, None), (901, "")])
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.learn(df, labels)).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(200)) and not got[900].toxic and got[901].severity < 1
    assert not any(r.toxic for r in toxicity.score(df, toxicity.learn(df, labels.limit(0))).collect())


def test_packing(spark, rows):
    got = packing.pack_documents(make(spark, rows), capacity=512).collect()
    want = {}
    for doc, text in rows:
        ids = encoder(None).ids(text) + (2).to_bytes(4, "little")
        want[doc] = ids
    sequences = {}
    for r in got:
        assert zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens * 4 == len(want[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) * 4 == sum(len(want[d]) for d, _ in rows)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


def test_differencing():
    rng = random.Random(2)
    sizes = [rng.randint(1, 900) for _ in range(700)]
    parts = packing.pack(sizes, 1000)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(700)) and max(sums) <= 1000 and len(parts) <= sum(sizes) / 1000 * 1.05 + 1
    assert packing.difference([8, 7, 6, 5, 4], 2) and packing.pack([], 10) == []


def test_token_matrices(spark, rows):
    got = token_output.packed_matrices(make(spark, rows), capacity=128).collect()
    found = {}
    for r in got:
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found.setdefault(doc, {})[start] = bytes(r.input_ids[2 * a : 2 * b])
            assert r.position_ids[2 * a : 2 * b] == b"".join(i.to_bytes(2, "little") for i in range(b - a))
    for doc, text in rows:
        ids = encoder(None).ids(text) + (2).to_bytes(4, "little")
        assert b"".join(found[doc][s] for s in sorted(found[doc])) == b"".join(ids[i : i + 2] for i in range(0, len(ids), 4))


def test_media(spark, rows):
    for r in media.media_digest(make(spark, rows)).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    stream = media.mux(random.Random(1).randbytes(130_000))
    assert media.demux(stream[:1880] + stream[2068:]).lost == 1 and media.demux(b"x" * 400).damaged == 3


def test_url_filters(spark):
    urls = {1: "http://a.EXAMPLE.org/es/1?x", 2: "https://example.org/en/12", 3: "http://x.com/fr/", 4: "http://x.com", 5: None, 6: "no url", 7: "http://org/", 8: "http://notorg/x", 9: "http://x.net/casino/1", 10: "http://b.com/de/#/fr/"}
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/", "allow"), 8: (None, "allow"), 9: (None, "block"), 10: ("com/de/", "block")}


def test_url_index_equals_running_every_rule(spark):
    rules = url_filters.RULES + url_filters.PATTERNS
    ends = ["/img/banners/1.gif", "/topbanner", "/banner468x60.png", "/banner", "/casino/", "/casinos/", "/wp-login.php", "/es/", "/en/12", "/fr/x", "/de/"]
    hosts = ["ads.x.net", "ad.org", "adserver.example.org", "spam-farm.com", "b.spam-farm.net", "notads.x.net", "x.com", "EXAMPLE.org"]
    urls = {n: f"http://{h}{e}" for n, (h, e) in enumerate((h, e) for h in hosts for e in ends)}
    want = {}
    for n, url in urls.items():
        fits = [(r.rank, -i) for i, r in enumerate(rules) if url_filters.re.match(r.pattern, "".join(url_filters.split_url(url)), url_filters.re.S)]
        best = rules[-max(fits)[1]] if fits else None
        want[n] = (best.name, best.verdict) if best else (None, "allow")
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()} == want and want[0] == (None, "block")


def test_language_id(spark):
    rng = random.Random(4)
    lexicon = {"aa": ["karu", "miro", "tavo"], "bb": ["schlund", "grüße", "wert"]}
    docs = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(30)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]] + [(500, None, "aa"), (501, "12 !", "bb")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.add_language(df, language_id.learn(df)).collect()}
    assert all(got[i].lang_pred == k for i, t, k in docs if i < 500) and got[500].lang_pred == got[501].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    coder = language_id.Coder(language_id.fit({"aa": [b"karu miro tavo"]}))
    assert float((2.0 ** -coder.bits.reshape(-1, 256).astype("float64")).sum(axis=1).max()) <= 1.0001  # code lengths satisfy Kraft


def test_language_stage_rejects_what_was_not_learned(spark):
    rng = random.Random(5)
    lexicon = {"aa": ["karu", "miro", "tavo"], "bb": ["schlund", "grüße", "wert"]}
    clean = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(30)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    other = [(900, "новые правила вступят в силу в следующем месяце", None), (901, " ".join("".join(rng.choice("bcdfghjklmnpqxyz") for _ in range(7)) for _ in range(20)), None), (902, "12 !", "bb")]
    df = spark.createDataFrame(clean + other, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_known_languages(spark, df, "").collect()) == list(range(120))
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_known_languages(spark, unlabelled, "").count() == 123


@pytest.mark.parametrize("light", [1024, 4])
def test_simhash(spark, rows, light, monkeypatch):
    rng = random.Random(9)
    first = [rng.getrandbits(64) for _ in range(20)]
    fps = first + [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in first * 4]
    monkeypatch.setattr(simhash, "LIGHT", light)  # workers get the module by reference, so crowded blocks are also built here
    nodes = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "rep long, fp binary")
    links = simhash.block_links(nodes, simhash.pigeonhole_masks(64, 5, 3), 2)
    edges = {(min(r.src, r.dst), max(r.src, r.dst)) for r in links.where("dst is not null").collect()}
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 2 for a, b in edges)
    heavy = {(r.src, r.dst) for r in simhash.one_bit_links(nodes.selectExpr("rep as src", "fp"), 2).collect()}

    def classes(pairs):
        of = list(range(len(fps)))
        for _ in range(len(fps)):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    want = classes({(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2})
    assert classes(edges) == want == classes(heavy)
    # One crowded block: what its hub does not reach is found by the chunk pairs.
    block, matrix = simhash._Block(2), np.frombuffer(b"".join(f.to_bytes(8, "big") for f in fps), np.uint8).reshape(-1, 8)
    for at in range(0, len(fps), 7):
        block.add(np.arange(at, min(at + 7, len(fps))), matrix[at : at + 7])
    block.close()
    out = pa.Table.from_batches(list(block.take()), simhash.LINKS).to_pylist()
    found = {(r["src"], r["dst"]) for r in out if r["dst"] is not None}
    if light == 4:
        crowd = spark.createDataFrame([(r["src"], r["key"], bytearray(r["fp"]), r["rest"]) for r in out if r["dst"] is None], "src long, key long, fp binary, rest boolean")
        assert crowd.count() == len(fps) and classes(found) != want
        found |= {(r.src, r.dst) for r in simhash.crowded_links(crowd, 2).collect()}
    assert classes(found) == want


def test_near_duplicates(spark, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(spark, rows), words=3, bits=64, masks=simhash.pigeonhole_masks(64, 5, 3), max_distance=2).collect()}
    assert got[4].component_id == 3 and got[0].component_id == got[1].component_id == got[2].component_id == 0 and bytes(got[0].fp) == bytes(8)
    assert simhash.near_duplicates(make(spark, rows).limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(30)]
    swapped = [*item[:9], "zzz", *item[10:]]
    docs = [(1, " ".join([word() for _ in range(40)] + item)), (2, " ".join(swapped + [word() for _ in range(9)])), (3, " ".join(word() for _ in range(90))), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(make(spark, docs), bench).collect()}
    assert set(found) == {(1, 7), (2, 7)} and found[1, 7].doc_start == 40 + found[1, 7].item_start


def test_sharding(spark, rows):
    got = sharding.hilbert_shards(make(spark, rows), rows_per_run=7).collect()
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert len(got) == len(rows) and sum(r["size"] for r in got) == total
    largest = max(r["size"] for r in got)
    for shard in range(8):
        of = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in of) == list(range(len(of))) and abs(sum(r["size"] for r in of) - total / 8) <= largest
    curve = sharding.curve_table(2, 3)
    cells = sorted(range(64), key=curve.__getitem__)
    assert all(abs(a // 8 - b // 8) + abs(a % 8 - b % 8) == 1 for a, b in zip(cells, cells[1:], strict=False))
    assert sharding.hilbert_shards(make(spark, [])).count() == 0


def test_decontamination_finds_every_accepted_match(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in (1, 3, 5, 8, 11, 12, 13, 15, 16, 20, 30)}
    docs, want = [], set()
    for n, item in items.items():
        run = min(n, 20)
        for k in range(run // 5 + 1):
            for shift in range(3):
                even = [*item]
                for j in range(k):
                    even[(j + 1) * run // (k + 1)] = "zzz"  # as far from each other as can be
                docs.append((len(docs), " ".join([word() for _ in range(5 + shift)] + even[:run] + [word() for _ in range(4)])))
                if sum(a == b for a, b in zip(even[:run], item, strict=False)) >= 0.8 * run:
                    want.add((docs[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(spark, docs), bench).collect()} == want and len(want) == len(docs)


def test_near_dedup_stage(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    text = lambda: [rng.choice(words) for _ in range(300)]
    docs, copies = [], []
    for i in range(60):
        base = text()
        near = list(base)
        for at in rng.sample(range(300), 3):  # 3 words in 15 of 296 shingles each: a similarity of 0.9
            near[at] = "other"
        docs += [(i, " ".join(base)), (1000 + i, " ".join(near))]
        copies.append(1000 + i)
    docs += [(5000, " ".join(text())), (5000, " ".join(text())), (5001, docs[0][1]), (5001, docs[0][1]), (None, docs[2][1]), (None, "a text of its own"), (6000, None), (6001, "")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id long, text string, fp string, score double")
    got = simhash.keep_one_of_each(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, _ in kept if i is not None and i < 1000) == list(range(60))
    assert sum(i in copies for i, _ in kept if i is not None) <= 3
    assert sum(i == 5000 for i, _ in kept) == 2 and not any(i == 5001 for i, _ in kept)
    assert [t for i, t in kept if i is None] == ["a text of its own"] and [i for i, t in kept if not t] == [6000]
    assert simhash.keep_one_of_each(spark, df.limit(0), "").count() == 0


def test_near_dedup_recall():
    rng = np.random.default_rng(3)
    masks = simhash.split_masks(256, 11, simhash.tables_for(256, 11, 39, 0.985))
    assert sorted(sum(masks[:23], ())) == sorted(set(sum(masks[:23], ())))  # the first split is disjoint
    found, far = 0, 0
    for similarity in [0.8] * 200 + [0.5] * 100:
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
        shared = round(800 * similarity / (1 + similarity))
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 400 - shared, dtype=np.uint64) * np.uint64(2)])
        both = np.frombuffer(simhash.fingerprint(a, 256) + simhash.fingerprint(b, 256), np.uint8).reshape(2, -1)
        keys = simhash._keys(both, masks)
        linked = (keys[0] == keys[1]).any() and np.bitwise_count(both[0] ^ both[1]).sum() <= 48
        found, far = found + (linked and similarity == 0.8), far + (linked and similarity == 0.5)
    assert found >= 180 and far <= 3


def test_fingerprint_by_hand():
    import xxhash

    text = "The quick  brown\tFOX Über the"
    words = ["the", "quick", "brown", "fox", "Über", "the"]
    assert [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)] == simhash.shingle_hashes(text, 3).tolist()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(text, 3), 64), "big") == want
    assert simhash.shingle_hashes("Ab c", 3).tolist() == [xxhash.xxh64_intdigest("ab c", 42)] and simhash.fingerprint(simhash.shingle_hashes(" ", 3), 64) == bytes(8)


def test_suffix_groups_of_many(spark):
    rng = random.Random(21)
    line = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rest = lambda n: "".join(rng.choice("stuvwxyz ") for _ in range(n))
    rows = [(i, rest(rng.randint(0, 90)) + line[rng.randint(0, 40) : 230 - rng.randint(0, 40)] + rest(rng.randint(0, 90))) for i in range(70)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]
    for sizes in ({"run_bytes": 2000}, {"run_bytes": 1 << 20}):
        assert sorted(tuple(r) for r in suffix_dedup.removal_report(make(spark, rows), **sizes).collect()) == brute_removed(rows)
    assert suffix_dedup.removal_report(make(spark, [])).count() == 0


def test_decontamination_recall_of_planted_pairs(spark):
    """16 of 20 tokens equal, at random places: all found, through the broadcast and through the shuffle."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = {n: [word() for _ in range(20)] for n in range(220)}
    docs = []
    for n, item in items.items():
        changed = list(item)
        for at in rng.sample(range(20), 4 if n % 2 else 5):
            changed[at] = "zzz"
        docs.append((n, " ".join([word() for _ in range(rng.randint(0, 9))] + changed + [word() for _ in range(3)])))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    for limit in (1_000_000, 0):
        found = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.find_leaks(make(spark, docs), bench, broadcast_rows=limit).collect()}
        assert found == {(n, n, 16) for n in items if n % 2}


def test_masks_lose_nothing():
    import itertools

    for run, k in ((5, 1), (10, 2), (15, 3)):
        masks = decontaminate.spaced_masks(run, k)
        assert any(m[-1] + 1 > len(m) for m in masks)  # some position is ignored
        for gone in itertools.combinations(range(run), k):
            assert any(not {s + p for p in m} & set(gone) for m in masks for s in range(run - m[-1]))


def test_decontamination_rows(spark):
    """Null and repeated ids, a token repeated thousands of times, an empty table on either side."""
    import time

    item = "one two three four five six seven eight nine ten eleven twelve"
    half = "one two three four five six"
    docs = [(None, "x " + item), (5, half), (5, "seven eight nine ten eleven twelve"), (5, None), (6, item), (6, item), (7, "la " * 12_000)]
    bench = spark.createDataFrame([(1, item), (2, "la la la la"), (None, "unasked")], "item_id long, text string")
    began = time.time()
    found = {(r.doc_id, r.item_id): r.doc_start for r in decontaminate.find_leaks(make(spark, docs), bench).collect()}
    assert found == {(None, 1): 1, (6, 1): 0, (7, 2): 0} and time.time() - began < 60
    assert decontaminate.find_leaks(make(spark, []), bench).count() == decontaminate.find_leaks(make(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_stage(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "so " + item, 0.1), (1, "a clean text", 0.2), (None, item, 0.3), (None, "clean too", 0.4), (2, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest double")
    got = decontaminate.drop_leaks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.digest for r in got.collect()) == [0.2, 0.4, 0.5]


def test_language_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(14)
    lexicon = {"aa": ["karu", "miro", "tavo"], "bb": ["schlund", "grüße", "wert"]}
    size = {"aa": 30, "bb": 6000}  # every text of bb is longer than what is learned of one
    docs = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(size[k])), k, i / 7) for i in range(60) for k in [("aa", "bb")[i % 2]]] + [(None, "karu miro", "aa", 0.5), (61, "", "bb", 0.25), (62, None, None, 0.125)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.add_language(df, language_id.learn(df), names=("a", "b", "c")).collect()}
    assert all(got[i].a == k and got[i].score == s for i, _, k, s in docs if i is not None and i < 60) and got[61].a == got[62].a == "und"
    kept = language_id.keep_known_languages(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id: r.score for r in kept.collect()} == {i: s for i, _, _, s in docs if i not in (61, 62)}
    assert language_id.keep_known_languages(spark, df.limit(0), "").count() == 0


def test_prediction_by_partial_matching_by_hand():
    """Code lengths of another coder: escape method C with exclusion, contexts of three bytes down to none."""
    from collections import Counter
    from math import log2

    texts = {"x": [b"abracadabra abra"], "y": [b"hocus pocus"]}
    coder = language_id.Coder(language_id.fit(texts))
    for j, name in enumerate(sorted(texts)):
        seen = Counter()
        for text in texts[name]:
            padded = b"   " + text
            for i in range(3, len(padded)):
                for d in range(4):
                    seen[padded[i - d : i], padded[i]] += 1
        for data in (b"abra", b"pocus abz", b"\xff"):
            bits, padded = 0.0, b"   " + data
            for i in range(3, len(padded)):
                open_ = set(range(256))
                for d in (3, 2, 1, 0):
                    counts = {b: seen[padded[i - d : i], b] for b in open_ if seen[padded[i - d : i], b]}
                    if not counts:
                        continue
                    escape = len(counts) if len(counts) < len(open_) else 0
                    if padded[i] in counts:
                        bits += log2(sum(counts.values()) + escape) - log2(counts[padded[i]])
                        break
                    bits += log2(sum(counts.values()) + escape) - log2(escape)
                    open_ -= set(counts)
                else:
                    bits += log2(len(open_))
            assert abs(coder.cost(data)[j] - bits) < 1e-3 * max(1, bits)


def test_ordinal_fit():
    """At the fit, no weight or cut moves the penalised likelihood down; grades come from the other half only."""
    rng = random.Random(4)
    rows = [[w for w in range(6) if rng.random() < 0.4] for _ in range(300)]
    grades = [min(3, max(0, len(r) - 2 + rng.randint(-1, 1))) for r in rows]
    model = toxicity.fit(rows, grades, [f"w{i}" for i in range(6)], ridge=0.001, steps=4000)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 3
    loss = lambda m: toxicity.negative_log_likelihood(m, rows, grades, [1.0] * 300) + 0.0005 * sum(w * w for w in m.weights)
    best = loss(model)
    for i in range(6):
        for step in (-0.05, 0.05):
            moved = [w + step * (i == k) for k, w in enumerate(model.weights)]
            assert loss(toxicity.Model(model.words, tuple(moved), model.cuts)) > best - 1e-6
    for i in range(3):
        for step in (-0.05, 0.05):
            assert loss(toxicity.Model(model.words, model.weights, tuple(c + step * (i == k) for k, c in enumerate(model.cuts)))) > best - 1e-6
    weighted = toxicity.fit(rows + rows, grades + grades, list(model.words), ridge=0.001, steps=500)
    half = toxicity.fit(rows, grades, list(model.words), ridge=0.001, steps=500, weights=[2.0] * 300)
    assert np.allclose(weighted.weights, half.weights)
    held, y = [[0], [0], [1], [1], [0, 1], []], [1, 1, 1, 0, 1, 0]
    first = toxicity.grade(held, y, 2, [0, 1, 0, 1, 0, 1])
    assert [g == 0 for g in first] == [label == 0 for label in y] and set(first) <= {0, 1, 2, 3}


def test_toxicity_rows(spark):
    """Null, empty and very long texts, repeated rows, labels that are null, repeated or without document; words by one tokeniser."""
    docs = [(i, f"you awful½word here {'so' * i}" if i % 3 == 0 else f"a fine day {i}") for i in range(120)] + [(500, None), (501, ""), (502, "fine " * 300_000), (503, "YOU AWFUL Word, here"), (503, "YOU AWFUL Word, here"), (None, "awful")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 0), (7, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    df = make(spark, docs)
    got = toxicity.score(df, toxicity.learn(df, labels)).collect()
    assert len(got) == len(docs) and all(r.toxic == (r.doc_id % 3 == 0) == (r.grade > 0) for r in got if r.doc_id is not None and r.doc_id < 120)
    assert [r.toxic for r in got if r.doc_id == 503] == [True, True] and not any(r.toxic for r in got if r.doc_id in (500, 501, 502))
    assert toxicity.score(df.limit(0), toxicity.Model((), (), ())).count() == 0
    assert "awful" in toxicity.features("Awful½") and "½" not in "".join(toxicity.features("Awful½"))


def test_media_column(spark):
    rows = spark.createDataFrame([(1, "plain text"), (2, None), (3, ""), (4, "ü" * 70_000)], "id long, t string")
    got = {r.id: (r.media, r.parsed) for r in media.with_parsed(media.with_media(rows, "t"), "media").collect()}
    assert got[2][0] is None and bytes(got[1][1]["payload"]) == b"plain text" and bytes(got[4][1]["payload"]).decode() == "ü" * 70_000
    assert [a["pts"] for a in got[4][1]["access"]] == [0, 3600, 7200] and all(a["random"] for a in got[4][1]["access"]) and got[4][1]["streams"] == {0x100: 6} and got[4][1]["lost"] == got[4][1]["damaged"] == 0
    assert media.media_digest(make(spark, [])).count() == 0


def test_matrices_as_files(spark, rows, tmp_path):
    made = token_output.packed_matrices(make(spark, rows), capacity=128)
    token_output.write_matrices(made, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == made.count() and {bytes(r.input_ids) for r in back.collect()} == {bytes(r.input_ids) for r in made.collect()}
    assert all(len(r.input_ids) == 256 for r in back.collect())
    wide = token_output.packed_matrices(make(spark, rows[:9]), capacity=64, id_bytes=4).collect()
    assert all(len(r.input_ids) == 256 for r in wide)
    with pytest.raises(Exception, match="does not fit"):
        token_output.packed_matrices(make(spark, rows[:9]), end_id=70_000).collect()
    assert token_output.packed_matrices(make(spark, [])).count() == 0


def test_packing_many_groups(spark, rows):
    got = packing.pack_documents(make(spark, rows), capacity=64, group_windows=4).collect()
    sums = {}
    for r in got:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 64 and sum(sums.values()) / (64 * len(sums)) > 0.85
    assert packing.pack_documents(make(spark, [])).count() == 0


def test_cells_of_many_values(spark):
    """More values than any table of known ones would hold: cells are of equal depth and in order."""
    df = spark.createDataFrame([(i, f"v{i % 4000:05d}" if i % 50 else None, "hot" if i % 3 else f"x{i}") for i in range(12_000)], "doc_id long, a string, b string")
    got = df.select("a", sharding._value_cell(df, "a", 4).alias("cell"), "b", sharding._value_cell(df, "b", 4).alias("other")).collect()
    known = sorted((r.a, r.cell) for r in got if r.a is not None)
    assert [c for _, c in known] == sorted(c for _, c in known) and {c for _, c in known} == set(range(16))
    sizes = [sum(c == k for _, c in known) for k in range(16)]
    assert max(sizes) < 1.3 * min(sizes) and all(r.cell == 0 for r in got if r.a is None)
    assert len({r.other for r in got if r.b == "hot"}) == 1
    empty = df.limit(0)
    assert empty.select(sharding._value_cell(empty, "a", 4)).count() == 0


def test_sharding_order_and_files(spark, rows, tmp_path):
    """Shards follow the curve: every row of a shard lies before every row of the next."""
    df = make(spark, [r for i, r in enumerate(rows) if i != 5])
    sharded = sharding.hilbert_shards(df, rows_per_run=5)
    got = sharded.collect()
    for a in range(7):
        ends, begins = [r.curve_index for r in got if r.shard == a], [r.curve_index for r in got if r.shard == a + 1]
        assert not ends or not begins or max(ends) <= min(begins)
    sharding.write_shards(df.drop("run"), sharded, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(got)
    with pytest.raises(ValueError, match="repeated"):
        sharding.write_shards(make(spark, rows), sharding.hilbert_shards(make(spark, rows)), str(tmp_path / "t"))


def test_queries_run_over_whole_tables(spark):
    from quarrygraph.llm.queries import QUERIES as found

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {name: f(spark, sf).collect() for name, f in found.items()}
    assert sorted(tuple(r)[:5] for r in got["op1_suffix_dedup"]) == brute_removed(texts)
    for name in ("op2_toxicity", "op4_media", "op6_language_id", "op7_simhash", "op10_sharding"):
        assert sorted(r.doc_id for r in got[name]) == sorted(i for i, _ in texts)
    assert {i for r in got["op9_token_output"] for i in r.doc_ids} == {r.doc_id for r in got["op3_packing"]} == {i for i, _ in texts}
    assert {r.doc_id: r.held_out for r in got["op6_language_id"]} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in texts}
    for r in got["op7_simhash"]:
        want = simhash.fingerprint(simhash.shingle_hashes(dict(texts)[r.doc_id], 3), 64).hex()
        assert r.fingerprint == want


def test_pipeline(spark, tmp_path):
    """Every stage's decision takes effect, on rows with nulls, repeats and columns named as the stages' own."""
    import corpus_pipeline

    rng = random.Random(31)
    words = {"en": [f"{a}{b}" for a in ("ka", "mi", "ta", "ru") for b in ("lo", "ven", "sor", "pim", "dax")], "de": [f"{a}{b}" for a in ("schl", "grü", "wa", "ob") for b in ("und", "ße", "rten", "acht", "eln")]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = [(i, text(("en", "de")[i % 2], 120), ("en", "de")[i % 2]) for i in range(80)]
    passage = text("en", 60)
    item = text("en", 25)
    docs += [(200, docs[0][1], "en"), (201, docs[0][1] + " kalo", "en"), (201, docs[0][1] + " kalo", "en")]
    docs += [(300, text("en", 90) + " " + passage + " " + text("en", 90), "en"), (301, text("en", 90) + " " + passage + " " + text("en", 90), "en")]
    docs += [(400, text("en", 30) + " " + item + " " + text("en", 30), "en"), (500, "12345 !!", "en"), (501, None, "de"), (502, "новые правила вступят в силу в следующем месяце сего года", None), (None, text("de", 100), None)]
    df = spark.createDataFrame([(i, t, k, "s", len(t or ""), 0.5, 7) for i, t, k in docs], "doc_id long, text string, lang string, source string, n_chars long, score double, run int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    clean = set(range(80)) | {None}
    assert set(kept["language_id"]) == clean | {200, 201, 300, 301, 400}
    assert set(kept["simhash_near_dedup"]) == clean | {300, 301, 400}
    assert set(kept["suffix_dedup"]) == clean | {300, 301, 400} and passage in kept["suffix_dedup"][300] and passage[50:150] not in kept["suffix_dedup"][301]
    assert set(kept["decontamination"]) == clean | {300, 301}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == clean | {300, 301}
    for i, parts in pieces.items():
        assert sum(n for _, n, _ in parts) == parts[0][2] == len(encoder(None).ids(kept["decontamination"][i])) // 4 + 1
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_language_is_learned_from_every_row(spark, monkeypatch):
    """Counts and the 99 % point over hundreds of rows a language and whole long texts, against the same in memory."""
    rng = random.Random(41)
    lexicon = {"aa": ["karu", "miro", "tavo", "zé"], "bb": ["schlund", "grüße", "wert", "x"]}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    size = lambda i: 9000 if i % 400 < 2 else rng.randint(1, 12)
    docs = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(size(i))), k) for i in range(2400) for k in [("aa", "bb")[i % 2]]]
    docs += [(next(i for i in range(5000, 6000) if not held(i)), "", "cc"), (None, "zzzz", "aa"), (2401, None, "bb"), (2402, "qqqq", None), (docs[0][0], "karu", "aa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    texts = {k: [t.encode() for i, t, lang in docs if lang == k and i is not None and t is not None and not held(i)] for k in ("aa", "bb", "cc")}
    assert min(len(texts[k]) for k in ("aa", "bb")) > 500 and max(len(t) for t in texts["aa"]) > 20_000
    want = language_id.fit(texts)
    model = language_id.learn(df)
    assert (model.languages, model.states, model.counts) == (want.languages, want.states, want.counts)
    few = language_id.fit(texts, 40)
    got = language_id.learn(df, 40)
    assert (got.states, got.counts) == (few.states, few.counts) and len(got.states) < len(model.states)
    monkeypatch.setattr(language_id, "HELD_GRAMS", 300)
    assert language_id.learn(df).counts == want.counts
    told = {k: [] for k in ("aa", "bb")}
    for i, t, k in docs:
        if i is not None and t is not None and k is not None and held(i):
            said, _, bits = language_id.predict(want, [t])[0]
            if said == k:
                told[k].append(bits)
    points = {k: sorted(v)[-(-99 * len(v) // 100) - 1] for k, v in told.items()}
    assert min(map(len, told.values())) > 250 and language_id.bounds(df, model) == {k: language_id.SLACK * v for k, v in points.items()}
