"""Operators on texts against brute force, and on awkward rows."""
from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alarmspan.llm import html_text, line_dedup, mixing, packing, secret_scan, simhash, token_counts, toxicity
from alarmspan.llm.links import components
from alarmspan.llm.tokens import encoder
from alarmspan.session import cut_lineage

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, ids string, fingerprint string, score int"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
AWKWARD = [
    (None, None, None, None, None, 1, "a", "f", 1),
    (None, "a text without an id", "en", "s1", 20, 2, None, None, 2),
    (1, None, "en", "s1", None, 3, "a", "f", 3),
    (2, "", "de", None, 0, 4, "a", "f", 4),
    (3, " \t\n\v ", "de", "s2", 5, 5, "a", "f", 5),
    (4, "<|endoftext|> stays <|ENDOFTEXT|> ÉÉ É ΣΑΣ İx 'S Don't ½ x² y z", "fr", "s2", 9, 6, "a", "f", 6),
    (5, LONG, None, "s1", 9, 7, "a", "f", 7),
    (6, LONG, "en", "s1", 9, 8, "a", "f", 8),
    (6, LONG, "en", "s1", 9, 8, "a", "f", 8),
    (7, "the " * 70_000 + "end", "en", "s3", 9, 9, "a", "f", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none_of(df):
    return df.where("1 = 0")


# Packing ------------------------------------------------------------------------------------------------------------

def check_packing(rows, texts, capacity=2048):
    encode = encoder(BYTE_BPE)
    wanted = Counter()
    for doc_id, text in texts:
        wanted[doc_id, tuple(encode(text or "").tolist() + [1])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(ids.tolist())))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    got = Counter()
    for (doc_id, total), parts in pieces.items():
        copies = sum(len(p) for _, p in parts) // total
        if copies == 1:
            at, whole = 0, []
            for start, ids in sorted(parts):
                assert start == at
                whole += ids
                at += len(ids)
            assert at == total
            got[doc_id, tuple(whole)] += 1
        else:  # rows with one id and length: compare their ids together
            got.update({k: n for k, n in wanted.items() if k[0] == doc_id and len(k[1]) == total})
            assert copies == sum(n for k, n in wanted.items() if k[0] == doc_id and len(k[1]) == total)
    assert got == wanted
    for parts in sequences.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= capacity
        assert at == capacity or at & (at - 1) == 0


def test_packing_round_trip(docs):
    check_packing(packing.pack_documents(docs, BYTE_BPE).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_awkward(awkward):
    check_packing(packing.pack_documents(awkward, BYTE_BPE).collect(), [(r[0], r[1]) for r in AWKWARD])
    assert packing.pack_documents(none_of(awkward), BYTE_BPE).count() == 0


def test_level_rule_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer, capacity = packing.LevelPacker(16), 16
    for i, size in enumerate(rng.integers(1, 16, 300)):
        costs = {}
        for level in [0, *[h for h in range(1, capacity - size + 1) if packer.count[h]]]:
            n = packer.count.copy()
            if level:
                n[level] -= 1
            if level + size < capacity:
                n[level + size] += 1
            costs[level] = int((n ** 2).sum())
        best = min(costs.values())
        assert packer.level_for(int(size)) == max(h for h, c in costs.items() if c == best)
        list(packer.place((i, 0, np.zeros(size, np.uint32), size)))
    left = list(packer.close())
    assert all(sum(len(p[2]) for p in w) in (1, 2, 4, 8, 16) for w in left)


def test_both_encoders_agree(docs):
    slow, fast = Tokenizer.from_file(BYTE_BPE), encoder(BYTE_BPE)
    for text in [r["text"] for r in docs.limit(60).collect()] + [r[1] or "" for r in AWKWARD[:6]]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


# Token counts -------------------------------------------------------------------------------------------------------

def counted_directly(rows):
    t = Tokenizer.from_file(WORD_BPE)
    return Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)


def test_token_counts(docs, awkward):
    for df in (docs, awkward):
        got = token_counts.count_tokens(df, WORD_BPE).select("doc_id", "n_bytes", "n_tokens").collect()
        assert Counter(map(tuple, got)) == counted_directly([(r["doc_id"], r["text"]) for r in df.collect()])
    assert token_counts.count_tokens(none_of(awkward), WORD_BPE).count() == 0


def test_token_counts_over_blocks(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 50)
    got = token_counts.count_tokens(docs.repartition(5), WORD_BPE, buckets=3).select("doc_id", "n_bytes", "n_tokens").collect()
    assert Counter(map(tuple, got)) == counted_directly([(r["doc_id"], r["text"]) for r in docs.collect()])


# SimHash ------------------------------------------------------------------------------------------------------------

def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(rows, most=4):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash_groups(docs, awkward):
    for df in (docs, awkward):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = simhash.near_duplicate_groups(df).collect()
        assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == slow_groups(rows)
    assert simhash.near_duplicate_groups(none_of(awkward)).count() == 0


@pytest.mark.parametrize("segments", [3, 5, 6])
def test_every_close_pair_is_found(spark, segments):
    rng = np.random.default_rng(segments)
    prints = {int(x) for x in rng.integers(0, 2 ** 63, 40)}
    for p in list(prints):
        for flips in range(1, 7):
            q = p
            for b in rng.choice(64, flips, replace=False):
                q ^= 1 << int(b)
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 4, segments).collect()
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert {frozenset(r) for r in got} == want


def shipped(df) -> bool:
    """Whether a join of ``df``, as run, sends one side to all tasks."""
    df.collect()
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_variants_of_a_small_table_are_not_shipped(spark):
    prints = spark.range(2000).selectExpr("xxhash64(id) AS fingerprint")
    nodes = cut_lineage(prints, "few-fingerprints")
    assert shipped(nodes.join(cut_lineage(prints, "same"), "fingerprint"))
    for segments in (3, 5):
        assert not shipped(simhash.close_pairs(nodes, 4, segments))


def test_longer_signatures_for_more_fingerprints():
    assert simhash.segments_for(10_000, 4) == 3 < simhash.segments_for(10 ** 9, 4) <= 8


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {x: x for p in pairs if p[0] != p[1] for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_groups(awkward):
    kept = simhash.first_of_groups(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == sorted(
        [(0, 0), (0, 20), (1, 0), (4, len(AWKWARD[5][1])), (5, len(LONG)), (7, len(AWKWARD[9][1]))])


# Line dedup ---------------------------------------------------------------------------------------------------------

def slow_line_dedup(rows, least):
    """rows in order: (doc_id, text).  A window of whole lines that stood before loses its lines."""
    seen, out = {}, []
    for place, (_, text) in enumerate(rows):
        lines = (text or "").split("\n")
        worded = [i for i, line in enumerate(lines) if line.encode().split()]
        gone = set()
        for s in range(len(worded)):
            words, e = 0, s
            while e < len(worded) and words < least:
                words += len(lines[worded[e]].encode().split())
                e += 1
            if words >= least:
                key = tuple(lines[i] for i in worded[s:e])
                if key in seen:
                    gone |= set(range(worded[s], worded[e - 1] + 1))
                else:
                    seen[key] = place
        out.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("least", [1, 12, 50])
def test_line_dedup(docs, least):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs.select("doc_id", "text"), least).collect()}
    assert [got[d] for d, _ in rows] == slow_line_dedup(rows, least)


def test_line_dedup_inside_one_text(spark):
    text = "a b c\n\nd e f\na b c\nd e f\ng h i\na b c\nd e f"
    df = spark.createDataFrame([(1, text), (2, "x\na b c\n\n\nd e f\ny")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(df, 6).collect()}
    assert got == {1: ("a b c\n\nd e f\ng h i", 8, 4), 2: ("x\ny", 6, 4)}


def test_line_dedup_awkward(awkward):
    out = line_dedup.drop_repeated_lines(awkward, 50)
    assert out.columns == [*awkward.columns, "n_lines", "n_removed"]
    texts = sorted((r["doc_id"] or 0, -1 if r["text"] is None else len(r["text"])) for r in out.collect())
    kept = sorted((r[0] or 0, -1 if r[1] is None else len(r[1])) for r in AWKWARD)
    assert texts == [(d, 0 if d == 6 else n) for d, n in kept]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert line_dedup.drop_repeated_lines(none_of(awkward)).count() == 0


def test_every_repeated_run_is_fingerprinted():
    rng = np.random.default_rng(2)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(1, 9))) for _ in range(12)]
    for _ in range(200):
        run = [lines[i] for i in rng.integers(0, 12, 6)]
        a = "\n".join([lines[i] for i in rng.integers(0, 12, 3)] + run)
        b = "\n".join(run + [lines[i] for i in rng.integers(0, 12, 3)])
        if sum(len(x.split()) for x in run) >= 10:
            prints = [{(h, w) for *_, h, w in line_dedup.windows(t, 10)} for t in (a, b)]
            assert prints[0] & prints[1]
            inside = {a.count("\n") - 5 + k for k in range(6)}
            assert any(at in inside for _, _, at, h, w in line_dedup.windows(a, 10) if (h, w) in prints[1])


def test_fingerprints_are_selected_places_and_matches_grow(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 6)) for _ in range(600)]
    docs = spark.createDataFrame([(i, i, "\n".join(lines[i * 60:i * 60 + 60])) for i in range(10)], "doc long, row long, text string")
    prints = line_dedup.fingerprints(docs, 50).collect()
    # Windows of nine lines select about two places in ten, each once, whichever windows share it.
    assert len({(p["doc"], p["at"]) for p in prints}) == len(prints) < 0.35 * sum(len(range(60 - 8)) for _ in range(10))
    ones = [p for p in line_dedup.selected("a b\nc d\n\ne f\ng h", 4)]
    places = [p for p in line_dedup.selected("x y\na b\nc d\n\ne f\nz", 4) if p[1] in {q[1] for q in ones}]
    runs = [line_dedup.extended(*p[2:], *q[2:4])[0] for p in places for q in ones if p[1] == q[1]]
    assert (min(r[0] for r in runs if r), max(r[1] for r in runs if r)) == (1, 4)


def test_line_dedup_finds_repeats_around_a_common_line(spark):
    # The common line is many windows' smallest; its earliest place stands in other surroundings than the repeats.
    rng = np.random.default_rng(4)
    common = [" ".join(f"c{k}" for _ in range(3)) for k in range(3)]
    some = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 3)) for _ in range(400)]
    rows = [(i, "\n".join(x for k in rng.integers(0, 400, 8) for x in (some[k], common[k % 3]))) for i in range(60)]
    rows += [(100 + i, "\n".join([*rows[i][1].split("\n")[3:-2], some[i], *rows[i + 1][1].split("\n")[2:9]])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (6, 12):
        got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df, least).collect()}
        assert [got[d] for d, _ in rows] == slow_line_dedup(rows, least)


# Mixing -------------------------------------------------------------------------------------------------------------

def test_exponent_meets_targets(spark):
    tokens = [5000, 900, 400, 300, 100]
    totals = spark.createDataFrame([(str(i), t) for i, t in enumerate(tokens)] + [("none", 0)], "source string, tokens long")
    p = np.array(tokens) / sum(tokens)

    def evenness(a):
        w = p ** a / (p ** a).sum()
        return -(w * np.log(w)).sum() / math.log(len(p))
    a = mixing.exponent(totals, mixing.Target(0.9, 1e9))
    assert evenness(a) == pytest.approx(0.9, abs=1e-6)
    b = mixing.exponent(totals, mixing.Target(0.9, 3.0))
    assert (50.0) ** (1 - b) == pytest.approx(3.0, abs=1e-6) and b > a
    assert mixing.exponent(totals, mixing.Target(0.1, 1.0)) == 1.0


@pytest.mark.parametrize("budget", [None, 3000])
def test_mix_reads_each_source_to_its_budget(spark, budget):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9))), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.Target(0.95, 4.0, budget)
    out = mixing.mix(df, target, block_docs=40).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    a = mixing.exponent(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), target)
    most = max(tokens.values())
    z = sum(t ** a for t in tokens.values())
    for s, total in tokens.items():
        quota = math.floor(total * (most / total) ** (1 - a) if budget is None else budget * total ** a / z)
        by_pass = defaultdict(Counter)
        for r in out:
            if r["source"] == s:
                by_pass[r["pass"]][r["doc_id"]] += r["n_tokens"]
        read = sum(sum(c.values()) for c in by_pass.values())
        assert quota <= read < quota + 9
        ids = {d for d, _, x in rows if x == s}
        for k, c in by_pass.items():
            assert set(c) == ids if k < max(by_pass) else set(c) <= ids
    last = [(r["block_key"], r["doc_key"]) for r in out if r["source"] == "hot" and r["pass"] == 0]
    assert len(set(last)) == len(last)


def test_mix_awkward(awkward):
    out = mixing.mix(awkward)
    assert out.columns == [*awkward.columns, "n_tokens", "pass", "block", "block_key", "doc_key"]
    assert set(r["_row"] for r in out.collect()) == {r[5] for r in AWKWARD}
    assert mixing.mix(none_of(awkward)).count() == 0


# Toxicity -----------------------------------------------------------------------------------------------------------

def test_toxicity_learns_and_leaves_the_fold_out(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        toxic = int(rng.random() < 0.25)
        body = list(rng.choice(words, 40)) + (["vile" + str(rng.integers(9)), "nasty"] if toxic else [])
        rows.append((i, " ".join(rng.permutation(body)), "en" if i % 2 else "de"))
        labels.append((i, toxic if zlib.crc32(str(i).encode()) % 5 else 1 - toxic))  # wrong labels in the held-out fold
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.fit_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, net).collect()}
    truth = {i: y if zlib.crc32(str(i).encode()) % 5 else 1 - y for i, y in labels}
    assert np.mean([(got[i]["score"] >= 0.5) == bool(y) for i, y in truth.items()]) > 0.97
    assert np.mean([got[i]["toxic"] == bool(y) for i, y in truth.items()]) > 0.97


def test_toxicity_score_is_of_the_text_alone_and_whole(awkward):
    net = toxicity.TextNet.fresh(1, np.random.default_rng(0).normal(size=toxicity.BUCKETS))
    scored = toxicity.score_documents(awkward, net)
    assert scored.columns == [*awkward.columns, "score_", "toxic"]
    by_text = defaultdict(set)
    for r in scored.collect():
        assert 0 <= r["score_"] <= 1
        by_text[r["text"]].add(round(r["score_"], 9))
    assert all(len(v) == 1 for v in by_text.values()) and by_text[None] == by_text[""]
    assert toxicity.score_documents(none_of(awkward), net).count() == 0
    assert net.logits([LONG + " zzz"])[0] >= -1e9


def test_stretches_do_not_change_scores(monkeypatch):
    net = toxicity.TextNet.fresh(2, np.random.default_rng(1).normal(size=toxicity.BUCKETS))
    texts = ["a b c d e", "", LONG, "one two", None]
    whole = net.logits(texts)
    monkeypatch.setattr(toxicity, "STRETCH", 37)
    assert np.allclose(whole, net.logits(texts), atol=1e-5)


def test_training_with_one_class_or_none():
    assert (toxicity.train(["a", "b"], np.array([0, 0]), ["en", "en"]).scores(["x"]) < 0.5).all()
    assert toxicity.train([], np.array([]), []).scores([""]).shape == (1,)


# Secrets ------------------------------------------------------------------------------------------------------------

def test_pattern_spans():
    text = ('é password = "short" api_key: \'AbCd1234.efgh5678\' TOKEN=abcdefghijkl password=secret:abcdefghijkl '
            "AKIA1234567890ABCD AKIA123 0123456789abcdef0 deadbeef")
    base, _ = secret_scan.scan(text)
    found = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in base]
    assert found == [("assign", "api_key: 'AbCd1234.efgh5678"), ("assign", "TOKEN=abcdefghijkl"),
                     ("access", "AKIA1234567890ABCD"), ("hex", "0123456789abcdef0")]


def test_randomness_tells_keys_from_patterns():
    rng = np.random.default_rng(7)
    alphabet = secret_scan.ALPHABETS["alnum62"]
    scores = np.array([secret_scan.randomness("".join(rng.choice(list(alphabet), 40)), alphabet) for _ in range(300)])
    assert 0.4 < scores.mean() < 0.6 and (scores < 0.05).mean() < 0.12
    assert secret_scan.randomness("a1" * 20, alphabet) < 1e-3
    assert secret_scan.randomness("internationalization2internationalization", alphabet) < 1e-3


def test_secret_scan_finds_unnamed_keys(spark):
    rng = np.random.default_rng(9)
    alphabet = list(secret_scan.ALPHABETS["alnum62"])
    # Decoys come from the text around a key, so the text has to be as varied as the corpus is.
    words = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(40).collect()).split()
    words = [w for w in words if w.isalpha()]
    rows = []
    for i in range(300):
        key = "".join(rng.choice(alphabet, 40)) if i % 3 else "chapter1section2paragraph3line4"
        rows.append((i, " ".join(rng.choice(words, 30)) + f" {key} " + " ".join(rng.choice(words, 30))))
    out = {r["doc_id"]: r["n_random"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([out[i] for i in range(300) if i % 3]) > 0.8
    assert np.mean([out[i] for i in range(300) if i % 3 == 0]) < 0.05


def test_secret_scan_awkward(awkward):
    rows = secret_scan.find_secrets(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["base"] == "" for r in rows)
    assert secret_scan.find_secrets(none_of(awkward)).count() == 0


# Pages --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, as sites do.</div><!-- <p>hidden</p> -->
<article><header><h1>Title &amp; more</h1></header><p><b>First   para<br>goes on.<p>Second&nbsp;one with <a href=x>a link</a>.</p>
<div class="ad">Buy this now, it is the best thing of all.</div><script>if (a < b) { "</p>" }</script><p>Yes.</p>
<aside>See also other things.</aside><ul><li>Item one of it</li><li>Item two of it</li></ul>
<form><label>Name</label><input><button>Send</button></form></article>
<section id="comments"><article class="comment"><p>I liked this article a lot, thank you for writing it.</p></article></section>
<footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE)[0] == "Title & more\nFirst para goes on.\nSecond one with a link.\nYes.\nItem one of it\nItem two of it"


def test_head_need_not_be_closed():
    page = "<html><head><title>T</title><meta charset=utf-8><article><h1>A</h1><p>b &lt;c&gt; &eacute;<br>d</article><footer>x"
    assert html_text.main_text(page)[0] == "A\nb <c> \u00e9 d"


def test_page_without_marked_part():
    body = "<div>" + "A sentence of some length stands here. " * 4 + "</div>"
    text = html_text.main_text(f"<ul><li><a>a</a><li><a>b</a></ul>{body}<p>short</p>{body}<div><a>c</a></div>")[0]
    assert text.count("\n") == 2 and "short" in text and not text.startswith("a\n")


def test_pages_awkward(spark):
    rows = [(1, None, "u", "x"), (2, "", None, "x"), (3, "<article><p>cut o", "u", "x"), (3, "<article><p>cut o", "u", "x"),
            (None, "plain & simple <", "u", "x"), (4, "<article>" + "<p>long text here</p>" * 20_000, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "html", "url", "text", "n_blocks"]
    texts = {(r["page_id"], r["n_blocks"]): r["text"] for r in got.collect()}
    assert texts[3, 1] == "cut o" and texts[1, 0] == texts[2, 0] == "" and texts[4, 20_000].count("\n") == 19_999
    assert html_text.extract_text(none_of(df)).count() == 0


def test_tree_fits_its_table():
    rows = np.array([[float(v) for v in line.split()] for line in html_text.LABELLED.strip().splitlines()])
    assert all(html_text.is_main(tuple(r[:-1]), html_text.tree()) == bool(r[-1]) for r in rows)
    assert len(rows) < 200


def test_fold_matches_crc(spark):
    from alarmspan.llm.common import in_fold
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", in_fold("doc_id").alias("f")).collect()
    assert all(r["f"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


del F


PARA = "<p>" + "These are words of a paragraph that goes on for quite a while. " * 4 + "</p>"


@pytest.mark.parametrize("page, n", [
    (f'<article class="post comments-open">{PARA}{PARA}</article>', 2),
    (f'<main class="with-sidebar">{PARA}{PARA}</main>', 2),
    (f'<div class="layout no-sidebar"><article>{PARA}{PARA}</article></div>', 2),
    (f'<div id="wrap" class="has-header"><nav>a b</nav><article>{PARA}{PARA}</article></div>', 2),
    (f'<form id="aspnetForm"><nav>home</nav><article>{PARA}{PARA}</article></form>', 2),
    (f'<html><head><title>never closed<body><article>{PARA}{PARA}</article></body>', 2),
    (f'<div class="comment layout"><div>{PARA}{PARA}</div></div>', 2),
    (f'<article>{PARA}<ul><li><a href=x>one two</a><li><a href=y>three four</a><li><a href=z>five six</a></ul>{PARA}</article>', 5),
    # Reader comments stay out, though they hold most of the words and are marked as articles themselves.
    (f'<article>{PARA}</article><section id="comments"><article class="comment">{PARA}{PARA}{PARA}</article></section>', 1)])
def test_names_do_not_lose_the_page(page, n):
    text, blocks = html_text.main_text(page)
    assert blocks == n and text.count("These are words") == 4 * page.count("<article>" + PARA) if n == 1 else blocks == n


def test_helper_names_are_free(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 1, 2, 3, 4)],
                                 "doc_id long, text string, _f_doc int, _f_row int, _w_id int, _w_key int")
    assert line_dedup.drop_repeated_lines(docs, 2).select(*docs.columns).count() == 2
    assert [r["doc_id"] for r in simhash.first_of_groups(docs).collect()] == [1]
    pages = spark.createDataFrame([(1, "<p>" + "word " * 40, 5)], "page_id long, html string, _read int")
    assert html_text.extract_text(pages).first()["_read"] == 5


def test_training_bounds_hold_for_rows_that_repeat(spark):
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"text {i % 3}", "en") for i in range(2000)] + [(i, "word " * i, "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2, "doc_id long, toxic int")
    sample = lambda **how: toxicity.training_sample(docs, labels, "doc_id", "text", "lang", "toxic", **how).collect()
    assert len(sample(longest=10 ** 6)) == len(ids) + 3
    few = sample(sample_docs=50, longest=700)
    assert len(few) == 50 and max(len(r["text"]) for r in few) <= 700
    assert sum(len(r["text"]) for r in sample(sample_chars=5_000, longest=10 ** 6)) <= 5_000


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 60_000)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words, 20)) + (f" vile{i % 9}" if i % 4 == 0 else ""), "en") for i in range(500)]
    long_id = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame(rows + [(long_id, "harmless " * 20_000 + "onlyhere", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows] + [(long_id, 1)], "doc_id long, toxic int")
    read = toxicity.labelled_rows(docs, labels, "doc_id", "text", "lang", "toxic").collect()
    outside = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(read) == len(outside) + 1 and max(len(r["text"]) for r in read) > 160_000 and len({r["shard"] for r in read}) > 4
    net = toxicity.fit_on(docs, labels)
    again = toxicity.fit_on(docs.repartition(5), labels)
    assert np.allclose(net.embedding, again.embedding, atol=1e-5)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i, *_ in rows]) > 0.97


def test_labelled_texts_cross_one_exchange(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(300)] + [(None, "no id", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 2)] + [(4, 1), (None, 1)], "doc_id int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity.labelled_rows(docs, labels, "doc_id", "text", "lang", "toxic")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted((r["text"], r["label"]) for r in found.collect()) == sorted(
        (f"text {i}", float(i == 4)) for i in range(0, 300, 2) if zlib.crc32(str(i).encode()) % 5)
