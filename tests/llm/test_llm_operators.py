"""Each operator against a brute-force version on small tables with nulls, repeats, empty texts and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, langid, licenses, packing, pieces, pii, quality, simhash, substring_dedup, toxicity, vec

# columns named like the operators' own, to clash with them
EXTRA = "lang string, source string, n_chars long, id long, th long, spans string, fp long, kept string, score double"
SCHEMA = f"doc_id long, text string, {EXTRA}"
WORD = re.compile("[^\x20\x09-\x0D]+")


def frame(spark, rows):
    full = [(i, t, ["en", None, "de"][n % 3], ["a", None][n % 2], len(t or ""), 7, 7, "x", 7, "x", 0.5) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def texts(seed=1, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "\x00", "a\x0bb", "A"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(13, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            t = f"{t} {p}\n" if rng.random() < 0.5 else f"{p}\t{t}"
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "  \n "), (103, rows[5][1]), (104, rows[5][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (None, None), (105, "lone"), (106, "z " * 3000)]
    return rows


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).limit(0)


def by_key(rows, key="doc_id"):
    return sorted((tuple(-1 if x is None else x for x in r) for r in rows), key=repr)


# substring dedup


def removed(rows, k):
    first = {}
    for i, t in rows:
        key = 2**63 - 1 if i is None else i
        w = WORD.findall(t or "")
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, key), key)
    out = []
    for i, t in rows:
        key = 2**63 - 1 if i is None else i
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < key:
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def test_substring_dedup_matches_brute_force(docs):
    got = substring_dedup.remove_repeated(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert by_key(got) == by_key(removed(ROWS, 13))


def test_substring_dedup_splits_large_shards(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SPLIT_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "HEAVY", 2)
    monkeypatch.setattr(substring_dedup, "PROBE", 1)
    got = substring_dedup.remove_repeated(docs, 5).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert by_key(got) == by_key(removed(ROWS, 5))


def test_substring_dedup_common_passage_in_many_settings(spark, monkeypatch):
    """One passage with settings shared by some documents each: its owner's shard is over the bound and cut finer."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, before, after = ([" ".join(word() for _ in range(n)) for _ in range(m)] for n, m in ((16, 1), (6, 25), (9, 25)))
    rows = [(i, f"{word()} {rng.choice(before)} {passage[0]} {rng.choice(after)} {word()}") for i in range(300)]
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "SPLIT_WORDS", 700)
    parts, shards = [], substring_dedup._shards
    monkeypatch.setattr(substring_dedup, "_shards", lambda s: parts.append(out := shards(s)) or out)
    got = substring_dedup.remove_repeated(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert by_key(got) == by_key(removed(rows, 13))
    assert len(parts) == 2 and parts[0].agg({"parts": "max"}).first()[0] > 2 and parts[1].agg({"parts": "max"}).first()[0] == 1


def test_substring_dedup_stage(docs, none):
    out = substring_dedup.drop_repeated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    want = {(i, " ".join(k.split())) for i, _, _, k in removed(ROWS, 13)}
    assert {(r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in out.collect()} == {(i, " ".join(WORD.findall(k))) for i, k in want}
    assert substring_dedup.remove_repeated(none).count() == 0 and substring_dedup.drop_repeated(none).count() == 0


def test_automaton_first_ids():
    rng = random.Random(3)
    for _ in range(30):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(4)]
        sam = substring_dedup.SuffixAutomaton()
        for n, s in enumerate(seqs):
            sam.add(s, n)
        sam.close(3)
        for s in seqs:
            want = [min((n for n, o in enumerate(seqs) if any(o[j : j + 3] == s[e - 2 : e + 1] for j in range(len(o) - 2))), default=None) for e in range(2, len(s))]
            assert sam.first_ids(s)[2:] == want


# SimHash


def near(rows):
    import xxhash

    fps = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(sh)))
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(fps[a] ^ fps[b]).count("1") <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    ids = {g: min((r[0] for r, x in zip(rows, label) if x == g and r[0] is not None), default=None) for g in label}
    return [(r[0], fp if fp < 1 << 63 else fp - (1 << 64), ids[g]) for r, fp, g in zip(rows, fps, label)]


def test_simhash_matches_brute_force(docs, none):
    assert by_key(simhash.near_duplicates(docs).collect()) == by_key(near(ROWS))
    assert simhash.near_duplicates(none).count() == 0


def test_bit_sliced_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.array([b ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))) for b in base for _ in range(40)] * 2, np.uint64)
    group = np.sort(rng.integers(0, 4, len(fps)))
    for right in (np.zeros(len(fps), bool), rng.random(len(fps)) < 0.4):
        a, b = simhash.close_pairs(fps, group, right, 3)
        want = set()
        for i in range(len(fps)):
            for j in range(len(fps)):
                if group[i] != group[j] or bin(int(fps[i] ^ fps[j])).count("1") > 3:
                    continue
                two = right[group == group[i]].any()
                if (not right[i] and right[j]) if two else i < j:
                    want.add((i, j))
        assert set(zip(a.tolist(), b.tolist())) == want


def test_simhash_splits_hot_buckets(docs, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    assert by_key(simhash.near_duplicates(docs).collect()) == by_key(near(ROWS))


def test_keep_one(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in near(ROWS)})


# SentencePiece and packing


def test_pieces_match_the_library(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.codec(path).model
    want = [(i, [1, *model.encode(t or ""), 2], model.decode([1, *model.encode(t or ""), 2])) for i, t in ROWS]
    assert by_key(pieces.encode(docs, path).collect()) == by_key(want)
    dig = pieces.encode_digests(docs, path).collect()
    assert by_key(dig) == by_key((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, x, d in want)
    assert pieces.encode(none, path).count() == 0


def test_packing_holds_every_id_once(docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = (public_tokenizers.path("byte_bpe_50k.json"), 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = packing.pack(docs, *args).collect()
    whole = {}
    for t in {t or "" for _, t in ROWS}:
        whole.setdefault(len(model.encode(t, add_special_tokens=False).ids) + 1, []).append(model.encode(t, add_special_tokens=False).ids + [1])
    assert sum(r.length for r in rows) == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    for r in rows:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(part) == r.length
        assert any(w[r.start : r.start + r.length] == part for w in whole[r.doc_tokens])
    for s in {r.sequence_id for r in rows}:
        mine = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
        total = sum(n for _, n in mine)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(none, *args).count() == 0


def test_packing_prefers_lexical_neighbours():
    texts_ = ["apple pear plum fig", "car bus train tram", "apple plum fig kiwi", "bus tram ship train"]
    df = np.zeros(1 << packing.TERM_BITS, np.int64)
    got = packing.pack_shard([4] * 4, packing.Index(texts_, df, 4, 16), width=8)
    assert [(r, s) for r, _, _, s, _ in got] == [(0, 0), (2, 0), (1, 1), (3, 1)]


def test_packing_deals_by_id_only_what_has_the_same_words(spark, monkeypatch):
    """A word whose hash is the smallest of all is in every text: pairs of copies still share a shard, at any number of shards."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    rng = random.Random(9)
    word = [f"w{i}" for i in range(3000)]
    hot = min(word, key=lambda w: vec.mix(packing._terms([w])[1], 77)[0])
    rows = [(i, " ".join([hot, *rng.sample(word, 30)])) for i in range(600)]
    rows += [(i + 1000, t) for i, t in rows] + [(i, "same words " * 4) for i in range(2000, 2400)]
    args = (public_tokenizers.path("byte_bpe_50k.json"), 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), *args, with_ids=False).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in out}
    assert len(set(shard.values())) > 50
    assert sum(shard[i] == shard[i + 1000] for i in range(600)) == 600
    copies = [shard[i] for i in range(2000, 2400)]
    assert len(set(copies)) > 1 and max(map(copies.count, copies)) < 200


@pytest.mark.parametrize("key", [None, 7])
def test_packing_deals_repeated_rows_and_null_ids(spark, monkeypatch, key):
    """Thousands of rows with one id, or none, and one text fill many shards evenly, and each comes out whole."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    args = (public_tokenizers.path("byte_bpe_50k.json"), 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([(key, "same words " * 4)] * 3000, "doc_id long, text string").repartition(8)
    out = packing.pack(df, *args, with_ids=False).collect()
    per = {}
    for r in out:
        per[r.sequence_id >> 32] = per.get(r.sequence_id >> 32, 0) + r.length
    assert len(per) > 20 and max(per.values()) < 6 * sum(per.values()) / len(per)
    assert sum(r.length for r in out) == 3000 * out[0].doc_tokens and sum(r.start == 0 for r in out) == 3000
    assert {r.doc_id for r in out} == {key}


# language


def test_ppm_costs_match_a_direct_walk(spark):
    rng = random.Random(4)
    rows = [("a", "".join(rng.choice("abcab ") for _ in range(80))) for _ in range(8)] + [("b", "".join(rng.choice("xyzab ") for _ in range(80))) for _ in range(8)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), rows=1000)
    before = (256,) * langid.ORDER
    counts = {}
    for lang, t in rows:
        b = before + tuple(t.encode())
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                seen = counts.setdefault((lang, b[i - k : i]), {})
                seen[b[i]] = seen.get(b[i], 0) + 1

    def p(lang, ctx, s):
        below = (lambda x: p(lang, ctx[1:], x)) if ctx else (lambda x: 1 / 256)
        c = counts.get((lang, ctx))
        if not c:
            return below(s)
        n, q = sum(c.values()), len(c)
        if s in c:
            return c[s] / (n + q)
        return q / (n + q) * below(s) / (1 - sum(below(x) for x in c))

    for test in ("abcxyz bac", "a", "", "zzz", "Qabc"):
        b = before + tuple(test.encode())
        want = [sum(-np.log2(p(lang, b[i - langid.ORDER : i], b[i])) for i in range(langid.ORDER, len(b))) for lang in model.langs]
        buf = np.frombuffer(test.encode(), np.uint8)
        assert np.allclose(model.bits(buf, np.array([0, len(buf)]))[0], want, rtol=1e-4)


def test_language_learns_from_texts_of_any_length(spark):
    """Texts of 0 to 5 bytes, all 256 bytes but those UTF-8 never holds, and one text past a block."""
    rows = [(i, "日"[: i % 2] + "abcdé"[: i % 6], "x" if i % 3 else "y") for i in range(60)]
    rows += [(100, "".join(map(chr, range(1, 1500))), "x"), (101, "lorem ipsum dolor " * (vec.BLOCK_BYTES // 16), "y"), (102, "日", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values()) and out[101].lang_pred == "y"
    assert langid.keep_identified(df, 0.0).count() == sum(any(c.isalpha() for c in t) for _, t, _ in rows)


def test_language_of_held_out_rows(spark, none):
    rng = random.Random(9)
    talk = {"en": "the and of with this ing tion er", "de": "der und nicht schen keit ein ung", "fr": "les des eaux que tion oire une"}
    rows = [(i, " ".join(rng.choice(talk[lang].split()) for _ in range(30)), lang) for i in range(120) for lang in [list(talk)[i % 3]]]
    rows += [(500, None, "en"), (501, "123 ---", "de"), (None, "der und ein ung", "de"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert got[None].lang_pred == "de" and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert langid.keep_identified(df).columns == df.columns and langid.keep_identified(df).count() == 121
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# licenses


def test_license_scan(spark, none):
    rows = [(1, "Released under the MIT License."), (2, "Apache License, Version 2.0! CC-BY-NC; under the mit license"), (3, None), (4, ""), (5, "this work is licenced under the gnu genral public license version 3"), (None, "cc by nc"), (5, "under the emit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))).collect()
    one = {(r.doc_id, r.n_words): r for r in got}
    assert (one[1, 5].base_labels, one[1, 5].first_word, one[1, 5].n_base, one[1, 5].score) == ("mit", 1, 1, 1.0)
    assert (one[2, 12].n_base, one[2, 12].first_word, one[2, 12].last_word, one[2, 12].labels) == (3, 0, 8, "apache-2,cc-by-nc,mit")
    assert one[3, 0].n_base == 0 and one[3, 0].first_word is None and one[4, 0].labels == ""
    assert one[5, 12].labels == "gpl-3" and 0 < one[5, 12].score < 1 and one[5, 12].notices[0].edits == 2
    assert one[None, 3].base_labels == "cc-by-nc" and one[5, 4].base_labels == ""
    assert licenses.scan(none).count() == 0


def test_fuzzy_finds_every_notice_within_its_edits():
    rng, scanner, alphabet = random.Random(5), licenses.Scanner(), "abcxyz"
    for _ in range(100):
        notice, label, k = rng.choice(scanner.notices)
        s = list(notice)
        for _ in range(rng.randrange(k + 1)):
            i = rng.choice([j for j, c in enumerate(s) if not c.isdigit()])
            s[i : i + 1] = rng.choice(["", rng.choice(alphabet), s[i] + rng.choice(alphabet)])
        found = scanner.fuzzy("foo bar " + "".join(s) + " qux")
        assert found and min(e for *_, e in found) <= k
        assert label in {x[0] for x in found}


def test_digits_of_a_notice_are_never_edited():
    scanner, gpl = licenses.Scanner(), "this work is licensed under the gnu general public license version "
    assert scanner.fuzzy(f"{gpl}1") == [] and [x[0] for x in scanner.fuzzy(f"{gpl}1 and {gpl}3")] == ["gpl-3"]


def test_license_base_matches_brute_force(spark):
    rng = random.Random(12)
    bits = ["under", "the", "MIT", "mit license", "license", "apache", "version", "2", "cc", "by", "nc", "é", "3", "\x00", "x"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "-", ". ", "", "\n"]) for _ in range(rng.randrange(40)))) for i in range(500)]
    rows += [(900, "x " * 600_000 + "cc by nc")]
    word, got = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        at = sorted((p, label) for phrase, label in licenses.PHRASES.items() for q in [phrase.split()] for p in range(len(ws)) if ws[p : p + len(q)] == q)
        want = (len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_fuzzy_finds_adjacent_notices_the_first_more_edited():
    scanner, gpl = licenses.Scanner(), "this work is licensed under the gnu general public license version "
    edited = "this wrk is licensed under the gnu generl public license version 2"
    found = scanner.fuzzy(f"{edited} {gpl}3")
    assert found == [("gpl-2", 0, 66, 2), ("gpl-3", 67, 135, 0)]
    # repeats of one notice, the best in the middle
    found = scanner.fuzzy(f"{edited} {gpl}2 {edited}")
    assert [(x[0], x[3]) for x in found] == [("gpl-2", 2), ("gpl-2", 0), ("gpl-2", 2)]


# toxicity


def test_toxicity_training_is_bounded_in_features(spark, monkeypatch):
    feats = spark.range(4000).select(F.xxhash64("id").alias("o"), (F.col("id") % 2).cast("int").alias("label"), F.sequence(F.lit(0), (F.col("id") % 100).cast("int")).alias("x"))
    whole = feats.agg(F.sum(F.size("x"))).first()[0]
    assert toxicity.bounded(feats, whole).count() == toxicity.bounded(feats, 2 * whole).count() == 4000
    tenth = toxicity.bounded(feats, whole // 10).agg(F.sum(F.size("x")).alias("n"), F.avg("label").alias("y")).first()
    assert 0.07 * whole < tenth["n"] < 0.13 * whole and 0.4 < tenth["y"] < 0.6
    assert toxicity.bounded(feats.limit(0), 10).count() == 0
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) + (" rotten" if i % 4 == 0 else "")) for i in range(2000)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_FEATURES", 40_000)
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lab).filter("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) >= 0.97 * len(got)


def test_toxicity_learns_and_scores(spark, none):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(20)) + (" rotten" if i % 4 == 0 else "")) for i in range(600)] + [(1000, None), (1001, ""), (None, "rotten w1")]
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i].predicted == int(i % 4 == 0) for i in held]
    assert sum(right) >= 0.97 * len(right)
    assert got[1000].score == got[1001].score and 0 <= got[1000].score < 0.5 and got[None].predicted == 1
    assert {r.score for r in toxicity.score(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, lab).count() == 0


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, p in enumerate(PLAIN.values()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_matches_plain_regexes(spark, none):
    rng = random.Random(3)
    bits = ["1", "2.", "12", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "é", "😀", "1.2.3.4", "+1 (555) 234-5678", "_", "%", "0300.1.1.1"]
    rows = [(n, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for n in range(400)]
    rows += [(900, None), (901, ""), (902, "1" * 30000), (903, "a" * 30000 + "@"), (904, "1." * 5000), (None, "x@y.zz"), (5, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit("clash"), "spans": F.lit(1)}).repartition(4)
    got = by_key((r.doc_id, [tuple(x) for x in r.base]) for r in pii.find(df).collect())
    assert got == by_key((i, base_spans(t)) for i, t in rows)
    assert pii.find(none).count() == 0


def test_pii_adds_and_redacts(spark):
    rows = [(i, f"call us at tel +1 (555) 234-56{i:02d} now") for i in range(10, 60)] + [(1, "phone (499) 555-6503 please"), (2, "mail bob@host.example.com, or 10.0.0.1"), (3, None)]
    df = spark.createDataFrame([(*r, "k", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, n_chars long")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert found[1].base == [] and [(x.s, x.e) for x in found[1].spans] == [(6, 20)]
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "phone <phone> please" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "mail <email>, or <ip>" and out[3].text is None and out[10].text == "call us at tel <phone> now"
    assert pii.redact(df).columns == df.columns


# nearest neighbours


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:340] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3), (None, v[0].tolist()), (780, [None] * 16), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("clash"), "block": F.lit(1)})
    got = {}
    for r in ann.search(df, 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = v.astype(np.float64) @ v[q].astype(np.float64)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([x for *_, x in found], s[[i for _, i, _ in found]], rtol=0, atol=1e-12)
        hit += len(set(want) & {i for _, i, _ in found})
    assert hit >= 0.9 * 20 * len(got)
    assert [i for _, i, _ in got[20]] == list(range(300, 320))
    few = ann.search(df.filter("vec_id < 5"), 20, 20).collect()
    assert len(few) == 4 and ann.search(df.limit(0), 20, 20).count() == 0


def test_ann_scores_doubles_as_doubles(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 8))
    found = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 20, 5).collect()
    assert len(found) == 15 and all(r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), abs=1e-13) for r in found)
    assert [r.vec_id for r in sorted(found) if r.query_id == 20] == [i for i in np.argsort(-(v @ v[20]), kind="stable") if i != 20][:5]


def test_shortlist_takes_first_of_equal():
    s = np.array([[1.0, 3, 2, 3, 2, 2], [0, 0, 0, 0, 0, 0]])
    assert ann.shortlist(s, 3).tolist() == [[1, 2, 3], [0, 1, 2]]


# quality


def counted(t):
    w = WORD.findall(t or "")
    seen = {}
    for p in range(len(w) - 7):
        seen.setdefault(tuple(w[p : p + 8]), []).append(p)
    cov = {x for v in seen.values() if len(v) > 1 for p in v for x in range(p, p + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w)


def test_quality_counts_and_verdict(spark, none):
    rows = ROWS + [(200 + i, ("ab cd " * 20 if i % 2 else " ".join(f"x{j}" for j in range(40 + i))) + "\nsame\nsame\n# $$") for i in range(6)]
    got = quality.judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert by_key(r[:7] for r in got) == by_key((i, *counted(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality.judge(none).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    rows = [(i, " ".join(["word"] * 1 + [f"w{i}x{j}" for j in range(40)]), "en", "s") for i in range(300)] + [(900, " ".join(f"### $$$ w{j}" for j in range(40)), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not got[900] and all(got[i] for i in range(300))


# hashing


def test_word_hashes_are_the_words(spark):
    import pyarrow as pa

    rng = random.Random(1)
    rows = ["".join(rng.choice("ab \t\né") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, ""]
    buf, off = vec.text_buffer(pa.array(rows))
    seen = {}
    for a, b in vec.blocks(off, 64):
        part = buf[off[a] : off[b]]
        ws, we, first = vec.words(part, off[a : b + 1] - off[a])
        row = vec.row_of_word(first)
        for h, s, e in zip(vec.word_hashes(part, ws, we).tolist(), ws, we):
            seen.setdefault(bytes(part[s:e]), set()).add(h)
        for i in range(a, b):
            assert [bytes(part[s:e]).decode() for s, e, r in zip(ws, we, row) if r == i - a] == WORD.findall(rows[i] or "")
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
