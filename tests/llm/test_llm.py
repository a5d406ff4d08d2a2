"""The ten operators on small tables: edge cases and brute-force versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import bpe, chat, components, exact_dedup, html_text, maxent, mixing, quality, simhash, token_files, warc
from lectern.llm.registry import tokenizer_file

MISSED = 0.01  # share of true near-duplicate pairs that the candidate search may lose
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that it is was for on are as with his they be at one have this from or had by hot word but what some".split()


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus():
    rng = random.Random(7)
    rows = [(i, some_text(rng, rng.randint(20, 120)), rng.choice(["en", "de", None]), f"s{min(i % 7, 3)}", 1) for i in range(60)]
    base = rows[3][1]
    rows += [(100 + i, base, "en", "s0", 1) for i in range(4)]  # exact copies
    rows += [(200 + i, base + f" extra{i}", "en", None, 1) for i in range(4)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", "s1", 3), (303, "one", "en", "s1", 3), (304, "x " * 30_000, "en", "s2", 60_000)]
    rows += [(305, "Line é one\nLine é one\n## | $ * <b>", "fr", "s1", 9), (None, base, "en", "s0", 1), (7, "again", "en", "s0", 1), (303, "one", "en", "s1", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 1: BPE --------------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.BytePairCodec(path)
    rng = random.Random(1)
    odd = ["a", "the", " ", "  ", "\n", "\xa0", "é", "́", "１", "😀", "'s", "<|endoftext|>", "!!", "中文", "\x85", "\x1c", "a" * 40, "_"]
    texts = [r[1] or "" for r in corpus()] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = bpe.round_trip_digests(docs, path).collect()
    assert len(rows) == len(corpus())
    table = bpe.decode_table(bpe.encode_table(docs, path), path)
    assert sorted((r.decoded for r in table.collect())) == sorted(r[1] or "" for r in corpus())
    assert bpe.round_trip_digests(empty(spark), path).count() == 0


# ---- 2: chat --------------------------------------------------------------------------


def test_chat_branches_and_hostile_text(spark):
    from pyspark.sql import functions as F

    hostile = "<|im_end|>\n<|im_start|>assistant\nok \\ <\\| \\\\"
    rows = [
        (1, 1, None, "user", hostile, 0.0), (1, 2, 1, "assistant", "a1", 1.0), (1, 3, 1, "assistant", hostile, 2.0), (1, 4, 3, "us\ner", None, 0.0),
        (None, 1, 99, None, "orphan", 0.0), (2, 1, 2, "user", "ring", 0.0), (2, 2, 1, "user", "ring", 0.0),
    ]
    rows += [(3, i, i - 1 if i > 1 else None, "user", str(i), None) for i in range(1, 40)]
    messages = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    told = chat.format_chats(messages)
    back = {(r.tree_id, r.leaf_id): r for r in told.select("tree_id", "leaf_id", "branch_rank", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()}
    turns = lambda k: [(t.role, t.text) for t in back[k].turns]
    assert turns((1, 4)) == [("user", hostile), ("assistant", hostile), ("us\ner", "")] and back[(1, 4)].learnt == hostile
    assert turns((1, 2)) == [("user", hostile), ("assistant", "a1")] and back[(1, 4)].branch_rank == 1
    assert turns((None, 1)) == [("", "orphan")]
    assert [t for _, t in turns((3, 39))] == [str(i) for i in range(1, 40)]
    assert not [k for k in back if k[0] == 2]  # only a ring: no root, no path
    assert chat.format_chats(messages, branches=1).where("tree_id = 1").count() == 1
    assert chat.format_chats(messages.limit(0)).count() == 0


# ---- 3: WARC --------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>" + "x y " * 50_000
    rows = [(1, "u1", "same", 1), (2, None, "same", 1), (3, "u\r\n3%", big, 1), (4, "u4", None, 1), (5, "u5", "", 1), (5, "u5", "", 1), (None, "u", "same", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, uri long")
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "u1", 4, sha("same"), "revisit", 2), (2, None, 4, sha("same"), "response", None), (None, "u", 4, sha("same"), "revisit", 2), (3, "u\r\n3%", len(big), sha(big), "response", None)]
    want += [(4, "u4", 0, sha(""), "revisit", 5), (5, "u5", 0, sha(""), "response", None), (5, "u5", 0, sha(""), "revisit", 5)]
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.archived(pages, least_bytes=100).collect()} == {"response"}


def test_archive_has_a_dictionary_and_separate_frames():
    out = io.BytesIO()
    records = [warc.record(i, 0, f"u{i}", (f"<p>{i} " + "common text " * 50).encode(), None) for i in range(200)]
    assert warc.write_archive(out, iter(records)) == 200
    assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert len(out.getvalue()) < sum(map(len, records)) / 2
    out.seek(0)
    assert [h["WARC-Page-ID"] for h, _ in warc.read_archive(out)] == [str(i) for i in range(200)]


# ---- 4: SimHash ------------------------------------------------------------------------


def slow_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_bpe_keeps_a_word_once_for_all_marks_after_it():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    codec, library = bpe.BytePairCodec(path), Tokenizer.from_file(path)
    texts = [f"Oftionnten{a} oftionnten{a} x{b}oftionnten" for a in ("", ".", ",", "!?", "'s", "\u00e9", "\n", "9", "...") for b in (" ", ", ", "\n", " \n", "\n ", "  ", "\u00a0", " '")]
    for text in [*texts, *texts]:  # from the table the second time
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert not any(len(codec.pattern.findall(piece)) != 1 for piece in codec.known)


def test_simhash_components_equal_brute_force(spark, docs):
    rows = [r for r in corpus() if r[0] is not None]
    fps = [slow_fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = slow_components(near, len(rows))
    low = collections.defaultdict(list)
    for r, k in zip(rows, root, strict=True):
        low[k].append(r[0])
    want = collections.Counter((r[0], f"{f:016x}", min(low[k])) for r, f, k in zip(rows, fps, root, strict=True))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).where("doc_id is not null").collect())
    assert got == want
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("options", [{}, {"chunk": 64, "giant": 96, "block": 16, "limit": 1, "take": 1}])
def test_linking_a_crowded_family_is_exact(spark, options):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 5) for b in range(1, 64, 9) for c in (2, 40)} | {rng.getrandbits(64) for _ in range(50)}
    fps |= {1 << a for a in range(0, 64, 3)} | {0, 1 | 2 | 4 | 8 | 1 << 40}  # a family about zero
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    prints = spark.createDataFrame([(f, [f]) for f in fps], "fid long, fp array<bigint>")
    mask = (1 << 64) - 1
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & mask).bit_count() <= 2]
    root = slow_components(near, len(fps))
    linked = {i for p in near for i in p}
    want = {fps[i]: fps[root[i]] for i in linked}
    got = {r.node: r.root for r in simhash.linked(prints, [(0, 32), (32, 32)], 1, 2, **options).collect()}
    assert {k: got[k] for k in want} == want and set(got) == set(want)


def test_strangers_of_a_crowd_cost_no_row_each():
    key = np.zeros(500, np.int64)  # one bucket: strangers that agree in this segment only
    fid, ones = np.arange(500), np.ones(500, np.int64)
    out = [b.to_pydict() for b in simhash._met([key, fid, fid, ones, ones], 16, 32, 16, 0.0)]
    kinds = collections.Counter(k for b in out for k in b["kind"])
    assert kinds[simhash._PAIR] == 0 and kinds[simhash._CROWDED] == 1


@pytest.mark.parametrize("limit", [1, 16])
def test_linking_among_strangers_of_a_crowd_is_exact(spark, limit):
    rng = random.Random(5)
    half = rng.getrandbits(32)
    highs = [rng.getrandbits(32) for _ in range(150)]
    highs += [h ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32) for h in highs[:40]]  # links in a crowd about one low half
    fps = sorted({h << 32 | half ^ (1 << rng.randrange(32) if k % 3 == 0 else 0) for k, h in enumerate(highs)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(f, [f]) for f in fps], "fid long, fp array<bigint>")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2]
    root = slow_components(near, len(fps))
    assert near
    want = {i for p in near for i in p}
    roots = {r.node: r.root for r in simhash.linked(prints, [(0, 32), (32, 32)], 1, 2, limit=limit).collect()}
    assert set(roots) == {fps[i] for i in want}
    assert all((roots[fps[i]] == roots[fps[j]]) == (root[i] == root[j]) for i in want for j in want)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    left = sorted((r.doc_id for r in simhash.near_dedup(docs.where("doc_id is not null")).collect()))
    assert not {100, 101, 102, 103, 200, 201, 202, 203} & set(left) and 3 in left and 5 in left
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_dedup(empty(spark)).count() == 0


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def altered(rng, words, places):
    """A copy with new words at some places."""
    words = list(words)
    for k in places:
        words[k] = f"new{rng.randint(0, 10**9)}"
    return words


def family_rows():
    """Pairs of every distance about Jaccard 0.8, far apart from each other."""
    rng, rows = random.Random(11), []
    for k in range(150):
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        other = altered(rng, base, [10 + 12 * i for i in range(1 + k % 8)])
        rows += [(2 * k, " ".join(base), "en", "s0", 1), (2 * k + 1, " ".join(other), "en", "s0", 1)]
    return rows


def test_near_dedup_links_by_exact_similarity(spark):
    rows = family_rows()
    left = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [shingle_set(r[1]) for r in rows]
    alike = {b: len(sets[b - 1] & sets[b]) / len(sets[b - 1] | sets[b]) for b in range(1, 300, 2)}
    assert left >= set(range(0, 300, 2))
    false = [x for b, x in alike.items() if b not in left and x < 0.8]
    missed = [x for b, x in alike.items() if b in left and x >= 0.8]
    assert min(alike.values()) < 0.7 and not false, false
    assert len(missed) <= MISSED * sum(x >= 0.8 for x in alike.values()), missed


@pytest.mark.parametrize("options", [{}, {"room": 20_000, "block": 16}])
def test_near_dedup_compares_no_stranger_with_each_member_by_rows(monkeypatch, spark, options):
    rng = random.Random(31)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]

    def changed(n):
        words = list(base)
        for at in rng.sample(range(0, 300, 5), n):
            words[at] = f"x{rng.randint(0, 10**9)}"
        return " ".join(words)

    # A family, rows near to all of it that link with none or few, and rows in reach of some
    texts = [changed(2) for _ in range(60)] + [changed(rng.choice((5, 6, 7))) for _ in range(60)]
    compared, write, link = [], simhash.written, simhash.linked
    monkeypatch.setattr(simhash, "written", lambda df, name: (out := write(df, name), compared.append(out.count()) if name == "near-pairs" else None)[0])
    monkeypatch.setattr(simhash, "linked", lambda *a, **k: link(*a, **k, **options))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    left = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [shingle_set(t) for t in texts]
    root = slow_components([(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], 120)
    assert left == {i for i in range(120) if root[i] == i} and 20 < len(left) < 60
    assert sum(compared) < 12 * len(texts)


@pytest.mark.parametrize("rows", [2, 10_000, 200_000, 3_000_000])
def test_near_dedup_searches_with_its_recall(monkeypatch, spark, docs, rows):
    seen = []
    monkeypatch.setattr(simhash, "linked", lambda prints, segments, *_, **__: seen.append(segments) or spark.createDataFrame([], "node long, root long"))
    monkeypatch.setattr(type(docs), "count", lambda self: rows)
    simhash.near_dedup(docs)
    [segments] = seen
    flip = math.acos(0.8 / 0.9) / math.pi
    found = [(1 - flip) ** b + b * flip * (1 - flip) ** (b - 1) for _, b in segments]
    assert 1 - math.prod(1 - f for f in found) >= 0.99
    assert {b for _, b in segments} == {max(24, 2 * math.ceil((math.log2(rows) + 6) / 2))}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (9, a + " end"), (9, d), (5, d + " more"), (6, e), (6, e), (6, e + " more"), (None, c)]
    left = simhash.near_dedup(spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)).collect()
    kept = collections.Counter((r.doc_id, r.text) for r in left)
    one = kept[(6, e)] + kept[(6, e + " more")]
    assert one == 1 and kept - collections.Counter({(6, e): 1, (6, e + " more"): 1}) == collections.Counter([(1, a), (None, b), (None, c), (5, d + " more")])


def test_near_dedup_compares_alike_at_any_number_of_rows(monkeypatch, spark, docs):
    seen = []
    monkeypatch.setattr(simhash, "linked", lambda prints, segments, words, most, **__: seen.append((segments, words, most)) or spark.createDataFrame([], "node long, root long"))
    for rows in (2, 10_000, 3_000_000, 12_000_000, 10**9):
        monkeypatch.setattr(type(docs), "count", lambda self, rows=rows: rows)
        simhash.near_dedup(docs)
    assert len({(words, most) for _, words, most in seen}) == 1
    assert all(start + bits <= 64 * words for segments, words, _ in seen for start, bits in segments)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (None, 1), (60, 61), (61, 60)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[61] == 60 and 50 not in got


def joined_rows(spark, run) -> int:
    """The rows that joins put out while ``run()`` runs, by Spark's own counts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for at in range(before, store.executionsCount()):
        ran = store.executionsList(at, 1).head()
        values, nodes = store.executionMetrics(ran.executionId()), store.planGraph(ran.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics() if "Join" in node.name() else None
            for metric in (metrics.apply(k) for k in range(metrics.size() if metrics else 0)):
                found = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and found.isDefined():
                    total += int(found.get().replace(",", ""))
    return total


def test_components_look_each_link_up_once_an_end(spark):
    links = [(i, j) for i in range(80) for j in range(i)] + [(i, i + 1) for i in range(79, 120)]  # a family and a chain
    edges = spark.createDataFrame(links, "u long, v long").coalesce(1).localCheckpoint()
    got = {}
    made = joined_rows(spark, lambda: got.update({r.node: r.root for r in components.connected_components(edges).collect()}))
    assert got == dict.fromkeys(range(121), 0)
    assert 2 * len(links) <= made < 3 * len(links)


def test_components_of_new_links_go_on_from_known_ones(spark):
    rng = random.Random(12)
    for _ in range(3):
        links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
        frames = [spark.createDataFrame(part, "u long, v long") for part in (links[:30], links[30:50], links[50:])]
        root = {x: x for pair in links if pair[0] != pair[1] for x in pair}
        for _ in links:
            for u, v in links:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        known = None
        for frame in frames:
            known = components.connected_components(frame, known)
        assert sorted(map(tuple, known.select("node", "root").collect())) == sorted(root.items())
    family = spark.createDataFrame([(i, j) for i in range(80) for j in range(i)], "u long, v long").coalesce(1)
    known = components.connected_components(family)
    more = spark.createDataFrame([(90, 5), (90, 91)], "u long, v long").coalesce(1)
    got = {}
    made = joined_rows(spark, lambda: got.update({r.node: r.root for r in components.connected_components(more, known).collect()}))
    assert got == dict.fromkeys([*range(80), 90, 91], 0)
    assert made < 150  # nodes and new links, not the 3160 old ones


# ---- 5: token files ----------------------------------------------------------------------


def test_blocks_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 50, 1500), rng.integers(0, 1 << 32, 700), np.zeros(600), [2**32 - 1]]).astype(np.uint32)
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    writer.add([1, None, 3], [10, 0, 990], ids[:1000])
    writer.add([4], [len(ids) - 1000], ids[1000:])
    writer.close()
    back = token_files.TokenFile(out)
    assert np.array_equal(back.read(0, back.total), ids) and np.array_equal(back.read(511, 1026), ids[511:1026])
    assert [(d, s, len(x)) for d, s, x in back.documents()] == [(1, 0, 10), (None, 10, 0), (3, 10, 990), (4, 1000, len(ids) - 1000)]
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(out.getvalue()[:-3]))


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted((r for r in corpus() if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    rows += []
    start, want = 0, []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_rows(docs.where("doc_id is not null"), path).collect())
    assert got == sorted(want)
    assert token_files.token_file_rows(empty(spark), path).count() == 0
    odd = ["A", "ab", "ΑΣ", "é", "\u0301", "\u0331", "H", "J\u030c", "İ", "K", "ß", ".", ",", "'s", "'LL", "²", "x²", "1", "½", "\xa0", "\x85", "\x1c", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "中", "😀", "|", "\x01"]
    rng = random.Random(6)
    hostile = ["ÀB<|endoftext|>c d", "ΑΣ ΑΣ", "é ́x", "a\xa0b c", "x<|startoftext|> y", "Word, word. WORD word., a,b. ,. .a ..,", ""]
    hostile += [" ".join("".join(rng.choice(odd) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))) for _ in range(600)]
    own = token_files.WordEncoder(path)
    own.LIMIT = 500  # forgotten now and then
    for at in range(0, len(hostile), 50):
        part = hostile[at : at + 50]
        ids, lengths = own.encode_all([t.encode() for t in part])
        cuts = np.split(ids, np.cumsum(lengths)[:-1])
        assert [x.tolist() for x in cuts] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in part]


def test_word_encoder_asks_once_for_words_alike():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.WordEncoder(path)

    class Counting:
        asked = 0

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            self.asked += sum(map(len, texts))
            return library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            self.asked += len(text)
            return library.encode(text, **options)

    own.library = Counting()
    stems = [a + "é" + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    signs = ["", ".", ",", "!!", ".,", "$$$", "'", "''", "&&&", ".###", "|>", "-"]
    texts = [" ".join(w + s for w in stems) for s in signs] + [" ".join(w.upper() + s for w in stems) for s in signs]
    texts += [" ".join(w.title() + s for w in stems) for s in signs]
    odd = ["été<|", "x<|endoftext|>", "|>été", "été's", "ÉTÉ'S.", "été\u0301.", "×", "÷é", "ªé", "ÿß.", "ŸẞİI.", "中文字", "ДА,", "ΣΑΣ", "ǅ", "K", "ﬁ", "각", "각", "<|startoftext|>.", "é" * 3000, "é" * 3000 + ",", "²", "é²."]
    texts += [" ".join(odd), " \t ".join(odd[::-1]) + " ", "", " \n", "</w> a</w>"]
    ids, lengths = own.encode_all([t.encode() for t in texts])
    cuts = np.split(ids, np.cumsum(lengths)[:-1])
    assert [x.tolist() for x in cuts] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert own.library.asked < 3000 * 3 + 2 * sum(map(len, stems))  # 36 times all stems before
    large, _ = own.encode_all(pa.array(texts, pa.large_string()))  # as Spark gives texts with useLargeVarTypes
    assert np.array_equal(large, ids)


def test_rows_come_to_the_encoder_by_size():
    rng = random.Random(3)
    texts = [None, "", "a" * 5000, *("b" * rng.randint(0, 300) for _ in range(400)), "c" * 5000, "d" * 5000, None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["_id", "_text"])
    batches = [whole.slice(0, 1), whole.slice(1, 0), whole.slice(1, 150), whole.slice(151, 3), whole.slice(154)]
    tables = list(token_files._by_size(iter(batches), 2000))
    assert [r["_text"] for t in tables for r in t.to_pylist()] == texts
    sizes = [sum(len(r["_text"] or "") + 16 for r in t.to_pylist()) for t in tables]
    assert all(n <= 2000 or t.num_rows == 1 for n, t in zip(sizes, tables, strict=True))
    assert all(a + b > 2000 for a, b in zip(sizes, sizes[1:]))


# ---- 6: mixing ---------------------------------------------------------------------------


def slow_targets(sizes):
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing_meets_targets_and_reruns_agree(spark, docs):
    sizes = collections.Counter()
    for r in corpus():
        sizes[r[3]] += len(words_of(r[1]))
    want = slow_targets(sizes)
    rows = mixing.taken(*mixing.mix(docs.where("doc_id <> 304 or doc_id is null"))).collect()
    assert len(rows) == len(corpus()) - 1 and all(r.taken <= 3 * r.size for r in rows)
    rows = mixing.taken(*mixing.mix(docs)).collect()
    assert all(abs(r.target - want[s]) < 1e-6 for r in rows for s in want if sizes[s] == r.source_size)
    again = mixing.taken(*mixing.mix(docs)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.taken(*mixing.mix(empty(spark))).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_splitting_tree_parts_quotas_exactly(shards):
    quotas = np.array([1000, 3, 0, 77])
    parts = [mixing.shard_quotas(quotas, k, shards, 9) for k in range(shards)]
    assert np.array_equal(sum(n for _, n in parts), quotas)
    sums = [int(n.sum()) for _, n in parts]
    assert max(sums) - min(sums) <= math.ceil(math.log2(shards)) if shards > 1 else sums == [1080]
    for s in range(4):
        spans = sorted((int(a[s]), int(a[s] + n[s])) for a, n in parts if n[s])
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][0], spans[-1][1]) == (0, quotas[s]))


def test_mix_takes_near_its_targets_from_every_shard(spark):
    rng = random.Random(21)
    rows = [(i, some_text(rng, rng.choice([5, 40, 60, 400])), "en", "abcd"[min(3, i % 9)], 1) for i in range(900)]
    table = spark.createDataFrame(rows, SCHEMA)
    placed, draws = mixing.mix(table)
    took, target = collections.Counter(), {}
    for r in mixing.taken(placed, draws).join(table.select("doc_id", "source"), "doc_id").collect():
        took[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(took[s] - target[s]) <= max(400, 0.01 * target[s]) for s in target), (took, target)
    shards = collections.Counter(r.shard for r in draws.collect())
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 4
    other = {(r.source, r.block, r.copy): r.shard for r in mixing.mix(table, seed=18)[1].collect()}
    assert other != {(r.source, r.block, r.copy): r.shard for r in draws.collect()}


def test_mixture_repeats_documents_as_drawn_and_shuffles_within_shards(spark, docs):
    from pyspark.sql import functions as F

    copies = {r.doc_id: r.copies for r in mixing.taken(*mixing.mix(docs)).where("doc_id between 8 and 299").collect()}
    clashing = docs.withColumns({"shard": F.lit("mine"), "_draw": F.lit(1), "size": F.lit(2)})
    mixed = mixing.mixture(clashing)
    assert mixed.columns == [*clashing.columns, "_shard"]
    parts = mixed.withColumn("part", F.spark_partition_id()).collect()
    rows = collections.Counter(r.doc_id for r in parts if r.doc_id is not None and 8 <= r.doc_id <= 299)
    assert {k: v for k, v in copies.items() if v} == dict(rows) and {r.shard for r in parts} == {"mine"}
    homes = collections.defaultdict(set)
    for r in parts:
        homes[r._shard].add(r.part)
    assert all(len(h) == 1 for h in homes.values()) and len(homes) > 4
    ids = [r.doc_id for r in parts if r.doc_id is not None]
    assert ids != sorted(ids) and [r.doc_id for r in mixing.mixture(clashing).collect()] == [r.doc_id for r in parts]
    assert mixing.mixture(empty(spark)).count() == 0


# ---- 7: language model ---------------------------------------------------------------------


def test_scores(spark, docs):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r[1] or "").encode().lower().split() + [b"\n"] for r in rows]
    count = collections.Counter(w for r, t in zip(rows, tokens, strict=True) if not held(r[0]) for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), held(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    got = maxent.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent.score(empty(spark)).count() == 0


def test_model_sums_to_one():
    model = maxent.Model()
    rng = np.random.default_rng(2)
    model.first[:] = rng.normal(size=model.first.shape)
    model.second[:] = rng.normal(size=model.second.shape)
    code = np.arange(maxent.HEAD)
    one = np.ones(maxent.HEAD, np.int64)
    head = np.exp(model.log_probs(code, 5 * one, 7 * one)).sum()
    kinds = np.array([maxent.HEAD + k for k in range(maxent.TAIL_CLASSES)] + [maxent.RARE])
    rest = np.exp(model.log_probs(kinds, np.full(len(kinds), 5), np.full(len(kinds), 7))).sum()
    assert abs(head + rest - 1) < 1e-4


def test_model_sees_the_third_last_word_and_every_context_code():
    rng = np.random.default_rng(5)
    codes = [rng.integers(0, maxent.CODES - 1, 4000).astype(np.uint16)]
    target, *context = maxent._contexts(codes)
    assert len(context) == 3 and list(context[2][3:]) == list(target[:-3])
    model = maxent.Model(rng.normal(size=(maxent.ROWS1, maxent.CLASSES)), rng.normal(size=(maxent.ROWS2, maxent.PER_CLASS)))
    far = [model.log_probs(np.full(2, 3), *(np.full(2, k) for k in (5, 7)), np.array([900, 901]))]
    # 900 and 964 shared a row of the second factor when codes were taken modulo 64.
    kind = np.zeros(2, np.int64)
    rows = model._second_rows(np.array([900, 964]), np.array([7, 7]), kind)[0][0]
    assert far[0][0] != far[0][1] and rows[0] != rows[1]


def test_training_steps_equal_dense_gradients():
    rng = np.random.default_rng(6)
    model, want = maxent.Model(), np.zeros((20, 4), np.float32)
    sums, total = np.zeros((20, 4), np.float32), np.zeros((20, 4), np.float32)
    model_weights = want.copy()
    for _ in range(3):
        r, kind = rng.integers(0, 6, 50), rng.integers(0, 4, 50)
        wrong = np.exp(model._logs(want, [(r, 10, 10)]))
        wrong[np.arange(50), kind] -= 1
        g = np.zeros_like(want)
        np.add.at(g, r + 10, wrong)
        total += g * g
        want = want - maxent._RATE * g / np.sqrt(total + 1e-6)
        model._step(model_weights, sums, [(r, 10, 10)], kind)
    assert np.allclose(model_weights, want, atol=1e-4)


# ---- 8: HTML -------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ('<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &lt;1&gt;</h1>'
     "<p>One  <b>two</b>\n three.<br>four<p>Short<script>var t='</p>';</script></article><footer>Foot</footer></body></html>", "Head <1>\nOne two three. four\nShort"),
    ('<header><h1>Site</h1></header><div id="main"><p>' + "Long text here. " * 20 + '</p><p>ok</p></div><aside>Side</aside><div class="comments"><p>' + "Nice post! " * 9 + "</p></div><form><p>Mail</p></form>",
     ("Long text here. " * 20).strip() + "\nok"),
    ("<article><p>cut off <b>he", "cut off he"), ("<nav>only</nav><script>x</script>", ""),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = ("Long text here with words. " * 12).strip()
ARTICLE, ARTICLE_TEXT = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p>", f"Title\n{LONG}\nShort."


@pytest.mark.parametrize("html", [
    f'<body><nav><a>x</a></nav><form id="aspnetForm">{ARTICLE}</form></body>',
    f'<div class="layout with-sidebar no-comments">{ARTICLE}</div>',
    f'<div class="has-sidebar"><article>{ARTICLE}</article><div class="sidebar"><p>Side text</p></div></div>',
    f'<div id=c>{ARTICLE}</div><section class="discussion"><p>I like this. {LONG}</p></section>',
    f'<div class="sidebar">{ARTICLE}</div><div class="site-footer">Foot</div>',
    f'<div id=c>{ARTICLE}</div><div class="comments">' + f"<div class=comment><p>{LONG}</p></div>" * 9 + "</div>",
    f"<ul><li><a href=1>Home</a><li><a>About</a></ul>{ARTICLE}",
])
def test_marks_do_not_silence_an_article(html):
    assert html_text.main_text(html) == ARTICLE_TEXT


def test_blocks_inside_an_article_stay():
    html = f'<article><p>{LONG}</p><p class="related-work">Rel.</p><p id="share">Sh.</p><div class="notice-period">NP.</div><p>Press <button>OK</button> now.</p></article>'
    assert html_text.main_text(html) == f"{LONG}\nRel.\nSh.\nNP.\nPress OK now."


def test_open_tags_take_linear_time():
    import time

    for hostile in ("<font><div>x", "<ul><li>", "<p>a</i></b></p><td>"):
        took = []
        for n in (2_000, 16_000):
            began = time.thread_time()
            html_text.main_text(hostile * n)
            took.append(time.thread_time() - began)
        assert took[1] < 24 * took[0] + 0.5, hostile


def slow_main_text(html):
    """The article of the test tables' pages, by cutting at tags."""
    import html as library

    inner = re.search(r"(?s)<article>(.*?)(</article>|$)", html or "")
    parts = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    plain = (" ".join(library.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts)
    return "\n".join(x for x in plain if x)


def test_extract_equals_brute_force_on_the_test_pages(spark):
    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(folder)
    want = {r.page_id: slow_main_text(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages.unionByName(pages)).collect()}
    assert got == want and len(want) > 20
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract_handles_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>é</p>")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("1", "", 0), ("None", "é", 1)]


# ---- 9: quality -----------------------------------------------------------------------------


def slow_metrics(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_metrics_and_fences(spark, docs):
    rng = random.Random(11)
    clean = [(1000 + i, some_text(rng, 60), "en", "big", 1) for i in range(150)]
    junk = [(2000 + i, " ### ".join(some_text(rng, 60).split()), "en", "big", 1) for i in range(5)]
    table = docs.unionByName(spark.createDataFrame(clean + junk, SCHEMA))
    got = quality.quality_verdicts(table).collect()
    want = collections.Counter(slow_metrics(r[1]) for r in [*corpus(), *clean, *junk])
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert sum(r[0] in kept for r in clean) == sum(not slow_metrics(r[1])[5] for r in clean) and not any(r[0] in kept for r in junk)
    assert sorted(str(r.doc_id) for r in quality.keep_good(table).collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.quality_verdicts(empty(spark)).count() == 0


def slow_bin_top(v):
    shift = max(v.bit_length() - quality.SUB - 1, 0)
    return ((v >> shift) + 1 << shift) - 1


def slow_kept(rows, prior):
    """Whether each (text, lang, source) is kept, with fences found by sorting."""
    found = [slow_metrics(t) for t, _, _ in rows]
    values = []
    for (t, _, _), (n, chars, signs, dup, rep, _) in zip(rows, found, strict=True):
        lines = sum(1 for x in (t or "").split("\n") if words_of(x))
        values.append({"word_length": chars * 1000 // max(n, 1), "symbols": signs * 1000 // max(n, 1), "dup_lines": dup * 1000 // max(lines, 1), "repeats": rep * 1000 // max(n, 1)})

    def own(members, metric):
        inner, outer, spread = quality.FENCES[metric]
        tops = sorted(slow_bin_top(values[i][metric]) for i in members)
        at = lambda q: tops[max(0, -(-len(tops) * q // 100) - 1)]
        room = spread * (at(outer) - at(inner))
        return len(tops), at(inner) - room, at(outer) + room

    def shrunk(one, wider):
        n, low, high = one
        return n, (n * low + prior * wider[1]) // (n + prior), (n * high + prior * wider[2]) // (n + prior)

    counted = [i for i, m in enumerate(found) if not m[5]]
    kept = []
    for i, (_, lang, source) in enumerate(rows):
        good = not found[i][5]
        for metric in quality.FENCES:
            whole = own(counted, metric)
            same = [j for j in counted if rows[j][1] == lang]
            fine = [j for j in same if rows[j][2] == source]
            if fine:
                _, low, high = shrunk(own(fine, metric), shrunk(own(same, metric), whole))
                good = good and values[i][metric] <= high and (metric not in quality.TWO_SIDED or values[i][metric] >= low)
        kept.append(good)
    return kept


@pytest.mark.parametrize("prior", [0, 200])
def test_quality_verdicts_equal_brute_force(spark, prior):
    rng = random.Random(12)
    rows = [(t, lang, source) for _, t, lang, source, _ in corpus()]
    for i in range(120):
        text = some_text(rng, rng.randint(8, 80))
        text = text.replace(" ", " # ") if i % 17 == 0 else text.replace(" ", "\n", i % 9) if i % 3 else text + "\n" + text.split()[0] + "\n" + text.split()[0]
        rows.append((text, ["en", "de", None][i % 3], ["a", "b", "b", None][i % 4]))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(table, prior=prior).collect()}
    want = slow_kept(rows, prior)
    assert [got[i] for i in range(len(rows))] == want and 10 < sum(want) < len(want) - 10


def test_keep_good_returns_clashing_columns_as_they_are(spark):
    rng = random.Random(13)
    rows = [(i, some_text(rng, 40), "en", "s", -i, f"w{i}", 2 * i, "v") for i in range(30)]
    names = ["doc_id", "text", "lang", "source", "n_words", "_metrics", "low", "_verdict"]
    table = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, quality.keep_good(table).collect())) == rows
    assert quality.keep_good(table).columns == names and quality.keep_good(table.limit(0)).count() == 0


def test_bins_hold_their_values(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000).select("id", quality.bin_of(F.col("id")).alias("b")).select("id", "b", quality.bin_top(F.col("b")).alias("top")).collect()
    assert all(r.id <= r.top <= r.id * 17 / 16 + 1 for r in rows) and all(a.b <= b.b for a, b in zip(rows, rows[1:], strict=False))


# ---- 10: exact dedup ---------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [500_000, 0])
def test_exact_dedup(spark, docs, bound):
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[r[1] or ""].append(r[0])
    rank = lambda i: -1 if i is None else i
    want = collections.Counter()
    for text, ids in groups.items():
        top = max(ids, key=rank)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=rank, reverse=True):
            want[(i, top, len(ids), first, sha)] += 1
            first = False
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, broadcast_bytes=bound).collect())
    assert got == want
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(60)), "en", f"s{i % 2}", 1) for i in range(120)]
    rows += [(500 + i, rows[0][1], "en", "s0", 1) for i in range(3)] + [(600, rows[1][1] + " more", "en", "s1", 1), (700, "short", "en", "s0", 1), (701, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in table.collect()]
    assert set(seen["quality_rules"]) == {r[0] for r in rows} - {700, 701}
    assert sorted(seen["exact_dedup"]) == sorted([*range(1, 120), 502, 600])
    assert sorted(seen["near_dedup"]) == sorted([*range(1, 120), 502])
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(collections.Counter(seen["mixing"]).values()) <= 3
    assert sorted(seen["bpe_encoding"]) == sorted(seen["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen["mixing"])
