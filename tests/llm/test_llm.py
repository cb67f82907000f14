"""Operators against brute force on a small hostile fixture, and on empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import byte_cnn, decontaminate, licences, mixing, quality_rules, simhash, substring_dedup, suffix_dedup, token_ids, warc
from tessera.llm.bytescan import text_buffers
from tessera.llm.keyed import ID, KEY

SPACE, SYMBOL = "[^\x20\x09-\x0D]+", "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fixture_rows():
    rng = random.Random(5)
    vocabulary = [f"wo{k}rd" for k in range(400)] + ["Größe", "É", "été", "don't", "#x", "K"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = prose(60), prose(200)
    odd = "a"  # two words of 1,024 letters whose polynomial hashes modulo powers of two are equal
    while len(odd) < 1024:
        odd += odd.translate(str.maketrans("ab", "ba"))
    fifty = prose(49)
    near = base.split(" ")
    near[100] = "changed"
    texts = [
        base, base, " ".join(near), prose(80) + " " + shared + " " + prose(10), shared + "\n" + prose(30), prose(5), "", None, "   \n\t ", "a", "ab " * 300, "x" * 5000,
        prose(3000), "line one two\nline one two\n \nother", "Licensed under the Apache License, Version 2.0. All rights reserved. CC BY cc by", "GNU General Public License, version 3", prose(40) + "  double  spaces \r\n end ",
        "the K elvin cc-by general public license general public license", "日本語 テキスト " * 20, "<|endoftext|> is text", prose(70).upper(), base,
        fifty + " " + odd, fifty + " " + odd.translate(str.maketrans("ab", "ba")), "w" * 300 + " " + fifty + " " + "w" * 300, "w" * 300 + " " + fifty + " " + "w" * 299 + "v",
    ]
    ids = list(range(0, 2 * len(texts), 2))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 7, "clash") for i, t in zip(ids, texts)]
    rows.append(rows[3])  # a row twice
    rows.append((None, base, "en", "s1", 1, "no id"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_words long, start string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def expect(fn):
    return sorted((fn(*r) for r in fixture_rows()), key=repr)


def test_quality_rules(docs, empty):
    def base(i, text, *_):
        text = text or ""
        w = re.findall(SPACE, text)
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        at = {}
        for s in range(len(w) - 7):
            at.setdefault(tuple(w[s : s + 8]), []).append(s)
        covered = {k for v in at.values() if len(v) > 1 for s in v for k in range(s, s + 8)}
        return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))

    found = quality_rules.quality_rules(docs)
    assert by_id(found.select(ID, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == expect(base)
    assert not found.filter("base_failed and kept").count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_outlier_is_rejected(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 8) for _ in range(rng.randint(80, 200))), "en", "s") for i in range(300)]
    rows.append((999, " ".join("#$%&x" for _ in range(20)) + " " + " ".join(str(k) + "***" for k in range(100)), "en", "s"))
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).withColumnRenamed(ID, "doc_id").collect()}
    assert not got[999] and sum(got.values()) >= 297


def _brute_mcd(x, groups, share, prior, floors, steps):
    """Squared distances, by arrays: per group the better of two starts after concentration steps."""
    scale, p = quality_rules.SCALE, x.shape[1]
    floor = np.diag([(f * scale) ** 2 for f in floors])

    def fitted(member):  # member: mask of the rows that count
        pooled, out = np.cov(x[member].T, bias=True), {}
        for g in set(groups):
            m = member & np.array([k == g for k in groups])
            n = m.sum()
            centre = (x[m].sum(0) + prior * x[member].mean(0)) / (n + prior)
            own = np.cov(x[m].T, bias=True) * n if n > 1 else np.zeros((p, p))
            scatter = quality_rules.consistency() * (own + prior * pooled) / (n + prior) + floor
            out[g] = (centre, scatter)
        return out

    def distances(fit):
        d = np.empty(len(x))
        for g, (centre, scatter) in fit.items():
            m = np.array([k == g for k in groups])
            y = x[m] - centre
            d[m] = np.einsum("ij,jk,ik->i", y, np.linalg.inv(scatter), y)
        return d

    def steps_from(fit):
        for _ in range(steps):
            bins = np.floor(np.log1p(distances(fit)) * quality_rules._BINS)
            member = np.zeros(len(x), bool)
            for g in set(groups):
                m = np.array([k == g for k in groups])
                b = np.sort(bins[m])
                member |= m & (bins <= b[int(np.ceil(share * m.sum() - 1e-9)) - 1])
            fit = fitted(member)
        return fit

    robust = {}
    for g in set(groups):
        q = np.quantile(x[np.array([k == g for k in groups])], [0.25, 0.5, 0.75], axis=0)
        robust[g] = (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor)
    ends = [steps_from(robust), steps_from(fitted(np.ones(len(x), bool)))]
    best = {g: min((e[g] for e in ends), key=lambda f: np.linalg.slogdet(f[1])[1]) for g in set(groups)}
    return distances(best)


def test_outlier_distances_are_those_of_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, (lang, source, n) in enumerate([("en", "a", 400), ("de", "a", 150), (None, "b", 60), ("en", None, 3)]):
        mixing_matrix = rng.normal(size=(5, 5)) * 300
        for _ in range(n):
            x = rng.normal(size=5) @ mixing_matrix + 1000 * g
            if rng.random() < 0.15:
                x += 6000
            rows.append((lang, source, *[int(v) for v in x]))
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} long" for i in range(5))).withColumn("n", F.monotonically_increasing_id())
    fair = table.drop("n").repartition(4)
    got = quality_rules._judged(table, quality_rules.estimate(fair)).collect()
    got = {(r.lang, r.source, *[r[f"x{i}"] for i in range(5)]): r.d2 for r in got}
    want = _brute_mcd(np.array([r[2:] for r in rows], float), [r[:2] for r in rows], quality_rules.SHARE, quality_rules.PRIOR, quality_rules.FLOORS, quality_rules.STEPS)
    assert max(abs(got[r] - w) / (1 + w) for r, w in zip(rows, want)) < 1e-6
    assert abs(quality_rules.consistency() - 1.4119) < 2e-3 and abs(quality_rules._chi_square(20.515, 5) - 0.999) < 1e-5


def _ordered():
    rows = [(i, t or "") for i, t, *_ in fixture_rows()]
    return sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)), rows


def test_substring_dedup(docs, empty):
    order, rows = _ordered()
    seen, out = {}, []
    for k in order:
        i, text = rows[k]
        w = re.findall(SPACE, text)
        gone = [0] * len(w)
        for s in range(len(w) - 49):
            first = seen.setdefault(tuple(w[s : s + 50]), i)
            if first is not None and (i is None or first < i):
                gone[s : s + 50] = [1] * 50
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    assert by_id(substring_dedup.substring_dedup(docs).collect()) == sorted(out, key=repr)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, empty):
    order, rows = _ordered()
    seen, out, twice = {}, [], Counter()
    for k in order:
        i, text = rows[k]
        b = text.encode()
        gone = bytearray(len(b))
        twice[i, b] += 1
        for s in range(len(b) - 99):
            first = seen.setdefault(b[s : s + 100], (i, b, s))
            if first != (i, b, s):
                gone[s : s + 100] = b"\1" * 100
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    got = by_id((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == sorted(out, key=repr)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def suffix_texts():
    rng = random.Random(3)
    yield b"a" * 400
    yield bytes(rng.choice(b"ab") for _ in range(600))
    block = bytes(rng.choice(b"\x00\xff\x7f") for _ in range(130))
    yield block + b"q" + block + block[5:] + bytes(200)


@pytest.mark.parametrize("length", [8, 13, 40, 100])
def test_suffix_array_is_the_order_of_the_bytes(length):
    for text in suffix_texts():
        data = np.frombuffer(text, np.uint8)
        at = np.arange(len(text) - length + 1)
        order, lead = suffix_dedup.suffix_array(data, suffix_dedup._words(data), at, length)
        strings = [text[i : i + length] for i in at]
        assert sorted(order) == list(at) and [strings[i] for i in order] == sorted(strings)
        assert list(lead) == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(order))]


@pytest.mark.parametrize("length", [8, 40, 100])
def test_levels_are_scanned_and_merged_in_order(length):
    def level(text, without=()):
        places = {text[i : i + length]: i for i in reversed(range(len(text) - length + 1))}
        kept = sorted(s for s in places if s not in without)
        return kept, suffix_dedup.Level(np.frombuffer(text, np.uint8), np.array([places[s] for s in kept], np.int64))

    texts = list(suffix_texts())
    for a in texts:
        for b in texts:
            old, first = level(a)
            new, second = level(b[: len(b) // 2] + a[: len(a) // 2])
            rank, found = first.scan(second, length)
            assert list(found) == [s in old for s in new]
            assert list(rank) == [sum(o < s for o in old) for s in new]
            fresh, third = level(b, old)
            if fresh:
                both = first.merge(third, length)
                assert [bytes(both.text[p : p + length]) for p in both.places] == sorted(old + fresh)
                assert list(both.key) == [int.from_bytes(s[:8], "big") for s in sorted(old + fresh)]


def test_contexts_of_equal_hashes_are_compared():
    raw = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    same = np.zeros(3, np.uint64)
    part = (same, same, same, np.arange(3), np.arange(3), np.zeros(3, np.int64), np.ones(3, np.int64), np.zeros(3, np.int64), raw, np.array([0, 100, 200]))
    (out,) = suffix_dedup._settle([part], 100)
    assert sorted((r[ID], r["context"]) for r in out.to_pylist() if r["context"]) == [(0, b"a" * 100), (1, b"b" * 100)]
    assert [r[ID] for r in out.to_pylist() if r["context"] is None] == [2]


def test_suffix_family_levels():
    rng = np.random.default_rng(0)
    family, seen = suffix_dedup.SuffixFamily(8), set()
    for _ in range(20):
        text = rng.integers(0, 2, 300).astype(np.uint8)
        at = np.arange(len(text) - 7)
        first = family.add(text, at)
        here = {}
        for k in at:
            s = text[k : k + 8].tobytes()
            assert (first[k] == -1) == (s in seen)
            if s not in seen:
                assert first[k] == here.setdefault(s, k)
        seen |= set(here)
        assert sum(len(level.places) for level in family.levels) == len(seen)
    assert len(family.levels) <= 9


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, None, big), (5, "http://c", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", "<i>"), (7, "u", "é" * 600)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == len(big)
    assert got[7].payload_bytes == 1200 and bytes(got[5].payload).decode() == big
    members = [warc.member(warc.record(k, "u", bytes([65 + k]) * 3000, None)) for k in range(6)]
    damaged = bytearray(members[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(damaged) + members[3] + b"junk WARC/1. junk" + warc.record(9, "u", b"plain", None) + members[4] + members[5][:-9]
    found = list(warc.salvage(data))
    assert [f["fields"]["warc-record-id"] for *_, f, _ in found if f] == [f"<urn:page:{k}>" for k in (0, 1, 3, 9, 4)]
    gaps = [(a, b) for a, b, f, _ in found if f is None]
    assert len(gaps) == 3 and sum(b - a for a, b in gaps) == len(damaged) + 17 + len(members[5]) - 9
    assert sorted((a, b) for a, b, *_ in found)[-1][1] == len(data)


def test_licences(docs, empty):
    def base(i, text, *_):
        w = re.findall(SYMBOL, low(text))
        at = {}
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            at[label] = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        every = sum(at.values(), [])
        return (i, len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(x for x in at if at[x])))

    found = licences.licences(docs)
    assert by_id(found.select(ID, "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == expect(base)
    labels = {r[ID]: r["labels"] for r in found.collect()}
    assert labels[28].split(",") == ["apache-2.0", "cc-by", "proprietary", "reserved"] and labels[30] == "gpl,gpl-3.0"
    assert labels[0] == "" and licences.licences(empty).count() == 0


def test_token_ids(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_ids.tokenizer_path())
    got = token_ids.encode(docs).collect()
    rows = {}
    for i, t, *_ in fixture_rows():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        rows[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert all((r.n_tokens, r.ids_crc32) == rows[r.doc_id] for r in got) and len(got) == len(fixture_rows())
    place = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == place
        place += r.n_tokens
    assert token_ids.encode(empty).count() == 0


def _encoded(encoder, texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, size = encoder(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_ids.tokenizer_path())
    encoder = token_ids.Encoder(token_ids.tokenizer_path())
    rng = random.Random(4)
    parts = ["a", "b", "É", "1", " ", " ", " ", "\n", "\t", "\r", "\x0b", "\u3000", "\x1c", "\0", "'s", "'", "!", "\u00a0", "\u0085", "\u2003", "\u180e", "\u200b", "日本語", "<|endoftext", "Thequiteverylongword"]
    texts = [" a\tb", "a\tb\tc   d", "a\tb\n c", " x", "x ", "", None, "  ", "q" * 300, " <|endoftext|>", "a <|endoftext|> b<|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    texts += ["".join(rng.choice([*parts, "<|endoftext|>"]) for _ in range(rng.randint(0, 24))) for _ in range(500)]
    rng.shuffle(texts)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert _encoded(encoder, texts) == want == _encoded(encoder, texts)
    monkeypatch.setattr(token_ids, "PIECES", 500)  # the memory starts anew again and again
    assert sum((_encoded(encoder, texts[i : i + 50]) for i in range(0, len(texts), 50)), []) == want


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = token_ids.tokenizer_path("word_bpe_49k.json")
    texts = ["Hello  World", "", "it's <|endoftext|> x", "a\nb"]
    assert _encoded(token_ids.Encoder(path), texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_token_files_can_be_read_selectively(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(str(rng.randrange(1000)) for _ in range(rng.randint(50, 150))), "x") for k in range(3000)]
    out = f"file://{tmp_path}/ids"
    token_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3), out, token_ids.tokenizer_path(), row_group=32 << 10, page=8 << 10)
    files = sorted(tmp_path.glob("ids/*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema.split(".")[0]: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start_in_part"))
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert meta.row_group(g).total_byte_size < 1 << 20
            groups += 1
    assert groups > len(files)  # several row groups a file
    # metadata alone, and the ids of a few documents
    lengths = token_ids.read_ids(spark, out).select("doc_id", "n_tokens")
    assert "ids:array" not in lengths._jdf.queryExecution().executedPlan().toString()
    few = token_ids.read_ids(spark, out).filter("doc_id between 1200 and 1202")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1200), LessThanOrEqual(doc_id,1202)" in few._jdf.queryExecution().toString()
    encoder = token_ids.Encoder(token_ids.tokenizer_path())
    assert [list(r.ids) for r in few.orderBy("doc_id").collect()] == _encoded(encoder, [rows[k][1] for k in (1200, 1201, 1202)])


def test_simhash(docs, empty):
    prints = {}
    for i, t, *_ in fixture_rows():
        w = re.findall(SPACE, low(t))
        k = min(4, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[s : s + k]).encode(), 42) for s in range(len(w) - k + 1)] if w else []
        prints.setdefault(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), []).append(i)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for p, ids in prints.items():
        for i in ids:
            if i is not None:
                least[find(p)] = min(least.get(find(p), i), i)
    want = sorted(((i, p if p < 1 << 63 else p - (1 << 64), least.get(find(p))) for p, ids in prints.items() for i in ids), key=repr)
    assert by_id(simhash.simhash(docs).select(ID, "fp", "component").collect()) == want
    kept = [r.doc_id for r in simhash.near_dedup(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(least.values())
    assert simhash.simhash(empty).count() == 0


def test_simhash_links_are_all_found():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 60).astype(np.uint64)
    fp = np.unique(np.r_[fp, fp ^ np.uint64(0b10110), fp ^ np.uint64(1 << 50)])
    want = {(int(a), int(b)) for a in fp for b in fp if int(a ^ b).bit_count() <= 4}
    assert {(int(x), int(y)) for u, v in simhash.links(fp, fp, 4) for x, y in zip(u, v)} == want


@pytest.mark.parametrize("per_pass", [1 << 20, 30])
def test_decontaminate(spark, docs, empty, monkeypatch, per_pass):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", per_pass)
    base = fixture_rows()[0][1]
    items = [(1, " ".join(base.split(" ")[20:45])), (2, "xx yy zz ww"), (3, None), (4, "--"), (5, "Licensed under the"), (1, "all RIGHTS reserved"), (10, "gnu")]
    table = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    windows = {}
    for k, t in items:
        w = re.findall(SYMBOL, low(t))
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(k))

    def want(i, text, *_):
        w = re.findall(SYMBOL, low(text))
        hit, held = [0] * len(w), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit[s : s + m] = [1] * m
                    held |= windows[tuple(w[s : s + m])]
        return (i, len(w), sum(hit), ",".join(sorted(held)))

    found = decontaminate.contamination(docs, table)
    assert by_id(found.select(ID, "n_words", decontaminate.hit_words().alias("h"), F.array_join("items", ",")).collect()) == expect(want)
    assert decontaminate.decontaminate(docs, table).count() == sum(x[2] == 0 for x in expect(want))
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).filter("size(hits) > 0").count() == 0


def test_mixing(docs, empty, spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(700)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(many).collect()
    size, taken, aim = Counter(), Counter(), {}
    for r in got:
        assert r["copies"] * r["size"] <= 2 * r["size"] and r["size"] == len(rows[r[ID]][1].split())
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        aim[r["source"]] = r["target"]
    weights = dict(zip(["a", "b", "c", None], [3, 1, 2, 3]))
    total, want, free = 1.5 * sum(size.values()), {}, set(weights)
    while free:
        rest, w = total - sum(want.values()), sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / w > 2 * size[s]]
        want |= {s: 2 * size[s] for s in over} or {s: rest * weights[s] / w for s in free}
        free = free - set(over) if over else set()
    for s in weights:
        assert abs(aim[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 60
    assert by_id(got) == by_id(mixing.mix(many.repartition(5)).collect())
    assert mixing.mixed(many).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs).count() == len({(r[0], r[1], r[3]) for r in fixture_rows()})
    assert mixing.mix(empty).count() == 0


def test_classifier(spark, docs, empty):
    good = lambda k: " ".join(random.Random(k).choices(["lorem", "ipsum", "dolor", "sit"], k=60))
    rows = [(k, good(k) if k % 3 else good(k).upper() + "!!" * 20) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = byte_cnn.learn(table, labels)
    got = {r.doc_id: r.predicted for r in byte_cnn.score(table, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and sum(got[k] == (k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in byte_cnn.score(docs, model).collect())
    assert byte_cnn.score(empty, byte_cnn.learn(empty, labels)).count() == 0


def test_classifier_is_the_network_it_says():
    rng = np.random.default_rng(1)
    model = byte_cnn.Model(rng.normal(0, 0.5, (byte_cnn.WIDTH, 257, byte_cnn.FILTERS)), rng.normal(0, 0.2, byte_cnn.FILTERS), rng.normal(0, 0.3, 2 * byte_cnn.FILTERS), np.array(0.2))
    texts = [np.frombuffer(t, np.uint8) for t in (b"", b"a", "déjà vu 1999 Привет".encode(), bytes(rng.integers(0, 256, 700, dtype=np.uint8)), b"x" * 256)]

    def loss_and_scores():
        scores = []
        for t in texts:
            n, chunks = max(1, -(-len(t) // byte_cnn.CHUNK)), []
            padded = np.r_[t.astype(int) + 1, np.zeros(n * byte_cnn.CHUNK + byte_cnn.WIDTH - len(t), int)]
            for c in range(n):
                conv = [sum(model.table[k][padded[i + k]] for k in range(byte_cnn.WIDTH)) for i in range(c * byte_cnn.CHUNK, (c + 1) * byte_cnn.CHUNK)]
                chunks.append(np.maximum(np.max(conv, 0) + model.bias, 0))
            z = np.r_[np.mean(chunks, 0), np.max(chunks, 0)] @ model.weight + model.intercept
            scores.append(1 / (1 + np.exp(-z)))
        p = np.array(scores)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)), p

    labels = np.array([1, 0, 1, 0, 1.0])
    assert np.allclose(byte_cnn.predict(model, texts), loss_and_scores()[1], atol=1e-5)
    grads = byte_cnn.gradient(model, texts, labels)
    places = [(0, tuple(x)) for x in np.argwhere(np.abs(grads[0]) > 1e-4)[::400]] + [(1, (k,)) for k in (0, 5)] + [(2, (k,)) for k in (0, 30)] + [(3, ())]
    values = [model.table, model.bias, model.weight, model.intercept]
    for f, at in places:
        old, losses = values[f][at].copy(), []
        for d in (1e-5, -1e-5):
            values[f][at] = old + d
            losses.append(loss_and_scores()[0])
        values[f][at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[f][at]) < 1e-4


def test_classifier_of_one_class_and_repeated_rows(spark):
    table = spark.createDataFrame([(k % 5, "same text") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(5)] * 2, "doc_id long, quality int")
    scores = {r.score for r in byte_cnn.score(table, byte_cnn.learn(table, labels)).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_pipeline_filters_as_its_operators_do(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r[ID] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    alone = simhash.near_dedup(docs.filter(F.col("doc_id").isin(*kept)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.decontaminate(alone, items).cache()
    copies = {r[ID]: r["copies"] for r in mixing.mix(clean).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


@pytest.mark.parametrize("hostile", [True, False])
def test_pipeline_of_hostile_and_empty_tables(spark, docs, empty, tmp_path, hostile):
    import corpus_pipeline

    items = [(1, " ".join(fixture_rows()[12][1].split(" ")[700:715])), (2, None), (3, "--")] if hostile else []
    (docs if hostile else empty).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = before.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, before, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        given, got = Counter(map(tuple, before.collect())), Counter(map(tuple, out.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            # filters keep rows as they are, the mix at most two of each
            assert all(n <= given[r] * (2 if name == "mixing" else 1) for r, n in got.items())
        else:
            assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(r[columns.index("doc_id")] for r in given.elements())
        seen[name], before = got, out
    if not hostile:
        assert not any(seen.values())
        return
    rows = {name: [r[:2] for r in found.elements()] for name, found in seen.items()}
    # what fails the base rules is gone, and of the whole texts given four times and more one stays
    few = {r[0] for r in fixture_rows() if len((r[1] or "").split()) < 20}
    assert not few & {i for i, _ in rows["quality_rules"]}
    base = fixture_rows()[0][1]
    assert [t for _, t in rows["quality_rules"]].count(base) == 4
    assert [t for _, t in rows["simhash_near_dedup"]].count(base) == 1
    # the benchmark passage lies far inside one long text
    assert [i for i, _ in rows["simhash_near_dedup"]].count(24) == 1
    assert 24 not in {i for i, _ in rows["decontamination"]}


def test_licences_finds_every_notice_of_a_file(spark):
    notice = {label: n for label, (n, _) in licences.TEMPLATES.items()}
    texts = [notice["mit"] + " filler " + notice["apache-2.0"], notice["bsd"] + " x " + notice["gpl-3.0"], "mozilla domain creative universal redistribution " + notice["gpl-3.0"], " and ".join(n for n in notice.values())]
    texts += [f"see {key} here" for _, key in licences.TEMPLATES.values()]  # the key phrase alone
    found = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    for r in found:
        words = texts[r[ID]].split()
        want, part = set(), 0.0
        for label, (n, key) in licences.TEMPLATES.items():
            place, n, key = len(n[: n.index(key)].split()), n.split(), key.split()
            for s in range(len(words) - len(key) + 1):
                if words[s : s + len(key)] == key:
                    want.add(label)
                    part = max(part, sum(0 <= s - place + k < len(words) and words[s - place + k] == w for k, w in enumerate(n)) / len(n))
        assert set(r["labels"].split(",")) - set(r["base_labels"].split(",")) == want and abs(r["score"] - part) < 1e-9


def test_near_dedup_links_what_brute_force_jaccard_links(spark):
    rng = random.Random(11)
    rows = [(i, t) for i, t, *_ in fixture_rows() if i is not None]
    for g in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(12, 300))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(3000)}"
            rows.append((1000 + len(rows), " ".join(w)))
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, low(t))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[s : s + k]) for s in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.near_dedup(table).select("doc_id").collect()) == sorted(least.values())
    assert simhash.near_dedup(table.limit(0)).count() == 0


def test_warc_reads_records_of_very_long_urls(spark, tmp_path):
    url = "data:text/html," + "x" * 200_000
    pages = spark.createDataFrame([(1, url, "<p>one"), (2, "u", "<p>two")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    got = {r.page_id: (r.kind, r.url, bytes(r.payload)) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: ("record", url, b"<p>one"), 2: ("record", "u", b"<p>two")}


def test_warc_of_hostile_pages(spark, empty, tmp_path):
    rows = [(i, t, lang, t, 1, "x") for i, t, lang, *_ in fixture_rows()]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, payload string, start long, kind string").repartition(3)
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(pages, folder, file_bytes=4000)
    (tmp_path / "w" / "part-000000-0000-999999.warc.gz").write_bytes(warc.member(warc.record(1, "u", b"left by a lost attempt", None)))
    got = warc.read_archives(spark, folder, archives).filter("kind = 'record'").collect()
    want = sorted(((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)
    assert archives.count() > 3 and sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=repr) == want
    none = warc.write_archives(empty.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"}), f"file://{tmp_path}/none")
    assert none.count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/none", none).count() == 0


def test_warc_reads_other_writers():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nbody"
    fields = lambda **extra: b"WARC/1.0\r\n" + b"".join(f"{k.replace('_', '-')}: {v}\r\n".encode() for k, v in extra.items()) + b"\r\n"
    records = [
        fields(WARC_Type="response", WARC_Payload_Digest="sha256:abcd", WARC_Record_ID="<urn:uuid:9-9>", Content_Length=len(block)) + block + b"\r\n\r\n",
        fields(WARC_Type="revisit", WARC_Payload_Digest="sha1:" + "zz" * 20, WARC_Record_ID="<urn:page:--5>", WARC_Refers_To="<urn:page:\u00b2>", Content_Length=len(block)) + block + b"\r\n\r\n",
        fields(WARC_Type="revisit", WARC_Payload_Digest="SHA1:" + "ab" * 20, WARC_Record_ID="<urn:page:" + "9" * 40 + ">", Content_Length=0) + b"\r\n\r\n",
        fields(WARC_Type="warcinfo", Content_Length=5) + b"a: b\n\r\n\r\n",
    ]
    got = [x for batch in warc._rows_of("a", warc.member(b"".join(records))) for x in batch.to_pylist()]
    assert [(x["kind"], x["record_type"], x["page_id"], x["payload_bytes"], x["payload_digest"]) for x in got] == [
        ("record", "response", None, 4, hashlib.sha1(b"body").hexdigest()), ("record", "revisit", None, None, None), ("record", "revisit", None, None, "ab" * 20), ("record", "warcinfo", None, 5, hashlib.sha1(b"a: b\n").hexdigest()),
    ]


def test_warc_reads_what_can_be_inflated_of_damaged_members():
    ids = lambda found: [int(f["fields"]["warc-record-id"][10:-1]) for *_, f, _ in found if f]
    last = warc.member(warc.record(9, "u", b"last", None))
    stored = [warc.record(k, "u", random.Random(k).randbytes(30_000), None) for k in range(4)]
    packed = [warc.record(k, "u", " ".join(str(x) for x in random.Random(k).choices(range(500), k=9000)).encode(), None) for k in range(4)]
    for records in (stored, packed):
        member = warc.member(b"".join(records))
        damaged = bytearray(member)
        for k in range(len(member) * 2 // 5, len(member) * 2 // 5 + 40):
            damaged[k] ^= 0xFF
        got = ids(warc.salvage(bytes(damaged) + last))
        assert got[0] == 0 and 1 not in got and got[-1] == 9
        assert ids(warc.salvage(member[:-20])) in ([0, 1, 2, 3], [0, 1, 2])
    bare = b"".join(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" for _ in range(3))
    assert len([f for *_, f, _ in warc.salvage(warc.member(bare)) if f]) == 3
    assert not [f for *_, f, _ in warc.salvage(warc.member(bare)[:-9]) if f]  # nothing vouches for them


def test_warc_reading_is_linear():
    one = warc.member(warc.record(1, "u", random.Random(1).randbytes(2000), None))
    took = []
    for n in (1000, 8000):
        begin = time.process_time()
        assert sum(1 for _ in warc.salvage(one * n)) == n
        took.append(time.process_time() - begin)
    assert took[1] < 16 * took[0] + 0.2  # 64 times if quadratic


def test_stages_keep_clashing_columns(spark, docs):
    clash = ["__key", "__id", "__text", "__k", "__s", "__same", "__from", "__copies", "__nth", "__N", "copies", "KEY_"]
    wide = docs.filter("doc_id is not null").dropDuplicates().select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    items = spark.createDataFrame([(1, "gnu general public")], "item_id long, text string")
    for out in (quality_rules.apply_rules(wide), simhash.near_dedup(wide), decontaminate.decontaminate(wide, items), mixing.mixed(wide)):
        assert out.columns == wide.columns and out.count() > 0
        assert out.subtract(wide).count() == 0


def test_warc_salvages_inside_members():
    records = [warc.record(k, "u", bytes(random.Random(k).randbytes(3000)), None) for k in range(5)]
    bad = bytearray(records[2])
    bad[len(bad) // 2] ^= 0xFF
    ids = lambda found: [f["fields"]["warc-record-id"] for *_, f, _ in found if f]
    whole = warc.member(b"".join([*records[:2], bytes(bad), *records[3:]]))
    found = list(warc.salvage(whole + warc.member(records[2])))
    assert ids(found) == [f"<urn:page:{k}>" for k in (0, 1, 3, 4, 2)]
    (gap,) = [x for x in found if x[2] is None]
    begin = len(records[0] + records[1])
    assert gap[:2] == (0, len(whole)) and f"inner bytes {begin} to {begin + len(bad)}" in gap[3]
    cut = warc.member(b"".join(records))
    found = list(warc.salvage(cut[: len(cut) // 2]))
    assert ids(found) == ["<urn:page:0>", "<urn:page:1>"]
    assert [x[:2] for x in found if x[2] is None] == [(0, len(cut) // 2)]


def test_wide_simhash_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 4, 5, 9, 12, 40, 300):
        for _ in range(12):
            base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            sets += [base, base[: -max(1, size // 6)], np.unique(np.r_[base[1:], rng.integers(0, 2**63, 1).astype(np.uint64)])]
    sets = sorted((s for s in sets if len(s)), key=len)
    n, lanes = np.array([len(s) for s in sets], np.int32), np.stack([simhash.wide(s) for s in sets]).T
    jaccards = {(x, y): len(c) / (n[x] + n[y] - len(c)) for x in range(len(sets)) for y in range(x) for c in [np.intersect1d(sets[x], sets[y])]}
    alike = [k for k, j in jaccards.items() if 0.8 <= j < 1]
    assert len(alike) > 50 and max(int(np.bitwise_count(lanes[:, x] ^ lanes[:, y]).sum()) for x, y in alike) <= simhash.reach(0.8, 1, 256)

    def labels(links):
        label = np.arange(len(sets))
        for x, y in links:
            label[label == label[x]] = label[y]
        return label

    got = [(x, y) for a, b in simhash.wide_links(n, lanes, n, lanes, True, 0.8) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    label = labels(got)
    assert all(label[x] == label[y] for x, y in alike) and len(got) < len(sets)
    # links are pairs within the radius, and a tile cut in two finds the same
    assert all(int(np.bitwise_count(lanes[:, x] ^ lanes[:, y]).sum()) <= simhash.reach(0.8, 1, 256) for x, y in got)
    half = len(sets) // 2
    cut = [(x, y + half) for a, b in simhash.wide_links(n[:half], lanes[:, :half], n[half:], lanes[:, half:], False, 0.8) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    label = labels(cut)
    assert all(label[x] == label[y] for x, y in alike if y < half <= x)


def test_near_dedup_takes_its_links_from_simhash(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, " ".join(words))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.near_dedup(docs).collect()] == [1]
    found = simhash.wide_pairs
    monkeypatch.setattr(simhash, "wide_pairs", lambda *a, **k: found(*a, **k).limit(0))
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [1, 2]
