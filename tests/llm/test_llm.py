"""The llm operators against brute force, on small fixtures with nulls, ties, repeats and odd texts."""

import datetime as dt
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from findlake.llm import bpe, packing, radix, truncation, truth

T0 = dt.datetime(2025, 1, 1)
HAVE = Path(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken").exists()
FINDING = (
    "finding_row long, finding_id string, status string, model string, severity string, cvss_score_estimate double, cwe_id string, evidence_tool string, reasoning string, recorded_at timestamp_ntz, "
    "repo_url string, file string, file_path string, function string, line int, start_line int, vuln_type string, tool string, detail string, extra string, row long, key string"
)
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], FINDING)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- p1: truth discovery


def brute_survivors(rows, trust):
    words = {"critical", "crit", "high", "hi", "medium", "med", "moderate", "low", "info", "informational"}
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    usable = lambda s: s is not None and plain(s) not in truth.NO_VALUE
    groups = defaultdict(list)
    for r in rows:
        if r.get("finding_id") is not None and plain(r.get("status") or "") != "error":
            groups[r["finding_id"]].append(r)
    out = []
    for fid, group in groups.items():
        if len(group) < 2:
            continue

        def rank(r):
            model = re.sub(r"[@:].*$", "", re.sub(r"^.*/", "", r["model"])) if r.get("model") else ""
            return (trust.get(plain(model), 0.5), r.get("recorded_at") or dt.datetime.min, -r["finding_row"])

        sev = lambda r: any(w in words for w in re.split(r"[^a-z]+", (r.get("severity") or "").lower()))
        val = lambda r: r.get("cvss_score_estimate") is not None and 0 < r["cvss_score_estimate"] <= 10
        full = lambda r: sev(r) + val(r) + sum(usable(r.get(c)) for c in ("cwe_id", "evidence_tool", "reasoning"))
        out.append((fid, "primary", max(group, key=lambda r: (full(r), rank(r)))["finding_row"]))
        for name, ok in (("severity", sev), ("cvss_score_estimate", val)):
            if any(map(ok, group)):
                out.append((fid, name, max(filter(ok, group), key=rank)["finding_row"]))
    return sorted(out)


def random_reports(seed, n):
    rnd = random.Random(seed)
    pick = rnd.choice
    return [
        {
            "finding_row": k, "finding_id": pick(["a", "b", "c", "hot", "hot", "hot", None, f"x{k}"]), "status": pick(["confirmed", "Error ", "error", None]),
            "model": pick([None, "m-1", "Lab/M 1@23", "m_2", "zz"]), "severity": pick([None, "High!", "[low]", "see vector", "", "CRIT", "Medium (2.8)"]),
            "cvss_score_estimate": pick([None, 0.0, 7.5, 10.0, 11.0, float("nan")]), "cwe_id": pick([None, "CWE-1", "n/a", "?"]), "evidence_tool": pick([None, "t", " ", "TBD"]),
            "reasoning": pick([None, "because", "Not set", "-"]), "recorded_at": pick([None, T0, T0, T0 + dt.timedelta(days=1)]), "extra": "e", "row": -1, "key": "clash",
        }
        for k in range(n)
    ]


def test_survivors_match_brute_force(spark):
    rows = random_reports(1, 300)
    reviewer = spark.createDataFrame([("m-1", 0.9, 1), ("m-2", 0.9, 1), (None, 0.1, 1)], "model string, reliability double, n_observed long")
    got = rows_of(truth.surviving_rows(frame(spark, rows), reviewer))
    assert got == brute_survivors(rows, {"m1": 0.9, "m2": 0.9}) and got


def test_survivors_of_empty_tables(spark):
    reviewer = spark.createDataFrame([], "model string, reliability double, n_observed long")
    assert rows_of(truth.surviving_rows(frame(spark, []), reviewer)) == []


def test_truth_discovery_finds_the_liar(spark):
    claims = [(f"o{k}", "f", v, s, k * 3 + i) for k in range(30) for i, (s, v) in enumerate([("good", "t"), ("fair", "t" if k % 3 else "u"), ("liar", "x")])]
    claims += [(f"p{k}", "f", v, s, 1000 + k * 2 + i) for k in range(10) for i, (s, v) in enumerate([("good", "t"), ("liar", "x")])] + [("q", "f", None, "good", 5000), (None, "f", "t", "good", 5001)]
    df = spark.createDataFrame(claims, "object string, field string, value string, source string, row long")
    prior = spark.createDataFrame([("good", 0.8)], "source string, reliability double")
    winners, trust = truth.truth_discovery(df, prior)
    assert {r.value for r in winners.collect()} == {"t"}
    t = {r.source: r.reliability for r in trust.collect()}
    assert t["good"] > t["fair"] > t["liar"]


@pytest.mark.parametrize("n", [1, 3])
def test_held_reliabilities_are_the_fixed_point(spark, n):
    """The loop with reliabilities held at their priors gives the required rows, whether it may run one round or three."""
    rows = random_reports(4, 120)
    claims = truth.survivor_claims(truth.candidates(frame(spark, rows)))
    prior = spark.createDataFrame([("m1", 0.9), ("m2", 0.4)], "source string, reliability double")
    winners, trust = truth.truth_discovery(claims, prior, anchored=True, max_iter=n)
    many = Counter(r["finding_id"] for r in rows if r["finding_id"] and (r["status"] or "").strip().lower() != "error")
    got = sorted((r.object, r.field, r.row) for r in winners.collect() if many[r.object] > 1)
    assert got == brute_survivors(rows, {"m1": 0.9, "m2": 0.4}) and got
    assert {r.source: r.reliability for r in trust.collect() if r.source in ("m1", "m2")} == {"m1": 0.9, "m2": 0.4}


def test_every_step_of_the_survivors_counts(spark, monkeypatch):
    """Given reliabilities are used as they are: no tables of votes and estimates that decide nothing, one vote per row."""
    steps = []
    monkeypatch.setattr(truth, "written", lambda df, name: steps.append(name) or df)
    rows = [{"finding_row": r, "finding_id": "a", "model": m, "severity": "high"} for r, m in ((1, "x"), (1, "y"), (2, "z"))]
    reviewer = lambda *r: spark.createDataFrame(r, "model string, reliability double")
    pick = lambda reviewer: rows_of(truth.surviving_rows(frame(spark, rows), reviewer))
    assert pick(reviewer(("x", 0.6), ("y", 0.6), ("z", 0.9))) == [("a", "primary", 2), ("a", "severity", 2)]  # row 1 twice is not 1.2
    assert pick(reviewer(("x", 0.6), ("y", 0.6), ("z", 0.5))) == [("a", "primary", 1), ("a", "severity", 1)]
    near = reviewer(("x", 0.9), ("y", 0.1), ("z", 0.9 + 1e-12))
    assert pick(near) == [("a", "primary", 2), ("a", "severity", 2)]  # no rounding
    assert steps == []


def test_survivors_of_planted_truth(spark):
    """Models of known accuracy report findings of known severity; the loop must find the severities and order the models."""
    rnd = random.Random(13)
    names = ["critical", "high", "medium", "low"]
    accuracy = {"a": 0.95, "b": 0.8, "c": 0.6, "d": 0.3}
    right = {f"f{k}": rnd.choice(names) for k in range(300)}
    rows = []
    for fid, sev in right.items():
        for m, acc in accuracy.items():
            said = sev if rnd.random() < acc else rnd.choice([x for x in names if x != sev])
            rows.append({"finding_row": len(rows), "finding_id": fid, "model": m, "severity": said.upper(), "status": "confirmed"})
    claims = truth.survivor_claims(truth.candidates(frame(spark, rows))).where("field = 'severity'")
    winners, trust = truth.truth_discovery(claims, spark.createDataFrame([], "source string, reliability double"))
    found = {r.object: r.value for r in winners.collect()}
    plain = Counter()
    for fid in right:
        votes = Counter(r["severity"].lower() for r in rows if r["finding_id"] == fid)
        plain[max(votes, key=lambda v: (votes[v], v)) == right[fid]] += 1  # ties by name, as no model is known to be better
    share = sum(found[f] == s for f, s in right.items()) / len(right)
    t = {r.source: r.reliability for r in trust.collect()}
    assert share >= 0.9 and share > plain[True] / len(right) and t["a"] > t["b"] > t["c"] > t["d"]


# --- p5: radix partitioning and tries


def brute_copies(rows):
    plain = lambda s: "\0" if s is None else re.sub(r"[\W_]", "", str(s).lower())
    first = lambda *v: next((x for x in v if x is not None), None)

    def pairs(s):
        if s is None:
            return "\0"
        return tuple(sorted(p for p in ("=".join(plain(x) for x in re.split("[=:]", q, maxsplit=1)) for q in re.split(r"[;,|\r\n]+", s)) if p not in ("", "=")))

    sets = defaultdict(list)
    for r in rows:
        key = (plain(r.get("repo_url")), plain(r.get("tool")), plain(first(r.get("file"), r.get("file_path"))), plain(r.get("function")), plain(first(r.get("line"), r.get("start_line"))), plain(r.get("vuln_type")), plain(r.get("cwe_id")), pairs(r.get("detail")))
        sets[key].append(r["finding_row"])
    return sorted((min(s), x) for s in sets.values() for x in s if x != min(s))


def random_findings(seed, n):
    rnd = random.Random(seed)
    pick = rnd.choice
    return [
        {
            "finding_row": k, "repo_url": pick([None, "", " ", "R/x"]), "tool": pick(["t", "T.", None]), "file": pick([None, "a/b.c", ".\\A\\b.c"]), "file_path": pick([None, "a/b.c"]), "function": pick(["f_g", "fG()", "h"]),
            "line": pick([None, 1]), "start_line": pick([None, 1, 2]), "vuln_type": pick(["sql_i", "sqlI"]), "cwe_id": pick(["CWE-1", "[cwe 1]", "", "-", None]),
            "detail": pick(["a=1;b=2", '{"b": "2", "a": "1"}', "B: 2, A: 1", None, "", "a=1;;b=" + "2" * 3]), "row": 7, "key": "k",
        }
        for k in range(n)
    ] + [{"finding_row": 10_000 + k, "function": "hot", "detail": "x=1"} for k in range(n // 2)]


@pytest.mark.parametrize("capacity", [radix.CAPACITY, 5])
def test_copies_match_brute_force(spark, capacity):
    rows = random_findings(2, 400)
    assert rows_of(radix.copies(radix.finding_keys(frame(spark, rows)), capacity)) == brute_copies(rows)


def test_radix_plan_splits_until_buckets_fit(spark):
    keys = [("abcd" + "x" * 9 + f"{k:05d}", k) for k in range(200)] + [("same", 1000 + k) for k in range(50)]
    entries = spark.createDataFrame([(k, 1, r) for k, r in keys], "key string, n long, first long")
    plan = radix.radix_plan(entries, 20)
    sizes = {r["bucket"]: (r["c"], r["d"]) for r in radix.with_bucket(entries, plan).groupBy("bucket").agg(F.count("*").alias("c"), F.countDistinct("key").alias("d")).collect()}
    assert plan and all(c <= 20 or d == 1 for c, d in sizes.values()) and sum(c for c, _ in sizes.values()) == 250


@pytest.mark.parametrize("common", [400, 10_000])
def test_radix_levels_do_not_depend_on_common_prefixes(spark, common):
    keys = ["k" * common + f"{k:04d}" for k in range(200)] + ["k" * common + "z" * common + f"{k:04d}" for k in range(100)] + ["k" * (common // 2)]
    entries = spark.createDataFrame([(k, 1, r) for r, k in enumerate(keys)], "key string, n long, first long")
    plan = radix.radix_plan(entries, 50)
    sizes = [r["count"] for r in radix.with_bucket(entries, plan).groupBy("bucket").count().collect()]
    assert len(plan) <= 4 and max(sizes) <= 50 and sum(sizes) == 301


def test_trie_counts_like_a_dictionary():
    rnd = random.Random(8)
    trie, want = radix.Trie(), {}
    for row in range(4000):
        key = radix.SEP.join(rnd.choice(["a", "b", "", "ab"]) for _ in range(rnd.randint(1, 5)))
        trie.add(key, 2, row)
        n, first = want.get(key, (0, row))
        want[key] = (n + 2, min(first, row))
    assert sorted(trie.terminals()) == sorted((k, n, f) for k, (n, f) in want.items()) and trie.size == len(want)


def test_copies_of_nothing(spark):
    assert rows_of(radix.copies(radix.finding_keys(frame(spark, [])))) == []


# --- p7: tokenization automaton


def toy():
    """A toy vocabulary of bytes and merges made by rule."""
    ranks = {bytes([b]): b for b in range(256)}
    for pair in [b"aa", b"ab", b"aaa", b"ba", b"abab", b"bab", b"aaaa", b"cd", b"bcd", b"abcd", b" a", b" ab"]:
        ranks[pair] = len(ranks)
    return ranks


def brute_bpe(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1)), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_automaton_matches_merging_by_rank():
    ranks, rnd = toy(), random.Random(3)
    automaton = bpe.Automaton(ranks)
    for _ in range(3000):
        word = bytes(rnd.choice(b"aabbcd x") for _ in range(rnd.randint(1, 14)))
        ids = automaton.encode(word)
        assert ids == brute_bpe(word, ranks) and automaton.decode(ids) == word


@pytest.mark.skipif(not HAVE, reason="no vocabulary files")
def test_ids_match_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(str(Path(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    alphabet = [chr(c) for c in range(32, 127)] + list(" \n\t\ré日本\U0001f642​﻿́ \x00")
    texts = ["", None, " ", "<|endoftext|> don't", "x" * 5000, "a b  c\n\n d", "the same", "the same"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert got == {k: own.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert rows_of(bpe.encode_corpus(df.limit(0))) == []


# --- p8: packing


@pytest.mark.parametrize("shard", [packing.SHARD, 50])
def test_packing_keeps_every_token_in_its_room(spark, shard):
    rnd = random.Random(5)
    sizes = [(k, rnd.choice([0, 1, 7, 100, 100, 500, 2047, 2048, 2049, 9000]) if k % 3 else rnd.randint(0, 900)) for k in range(1000)]
    df = spark.createDataFrame([(k, n, "c") for k, n in sizes] + [(1000, None, "c"), (None, 5, "c")], "doc_id long, n_tokens int, container_id string")
    rows = packing.pack(df, "doc_id", shard_items=shard).collect()
    per_doc, rooms = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        rooms[r.container_id].append(r)
    assert set(per_doc) == set(range(1001))
    for k, n in sizes:
        pieces = sorted(per_doc[k], key=lambda r: r.piece_no)
        assert [r.piece_no for r in pieces] == list(range(1, len(pieces) + 1)) and sum(r.n_tokens for r in pieces) == n
        assert len(pieces) == max(1, -(-n // packing.CAPACITY))  # only what is longer than the room is split
    for items in rooms.values():
        items.sort(key=lambda r: r.place)
        assert [r.place for r in items] == list(range(1, len(items) + 1)) and sum(r.n_tokens for r in items) <= packing.CAPACITY
        assert [r.start_token for r in items] == [sum(x.n_tokens for x in items[:k]) for k in range(len(items))]
    best = -(-sum(n for _, n in sizes) // packing.CAPACITY)
    assert len(rooms) <= best * (1.02 if shard > 50 else 1.25)


def test_packing_does_not_depend_on_row_order(spark):
    rows = [(k, (k * 37) % 700) for k in range(300)]
    packed = [rows_of(packing.pack(spark.createDataFrame(r, "doc_id long, n_tokens int"), "doc_id")) for r in (rows, rows[::-1])]
    assert packed[0] == packed[1]


def test_audit_of_packings(spark):
    rows = [(k, (k * 37) % 3000) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    packed = packing.pack(docs, "doc_id")
    assert [tuple(r) for r in packing.audit(packed, docs, "doc_id").select("n_documents", "n_missing", "n_over_capacity", "n_overlapping", "n_split_needlessly").collect()] == [(300, 0, 0, 0, 0)]
    bad = packed.where("doc_id <> 7").withColumn("n_tokens", F.when(F.col("place") == 1, 2049).otherwise(F.col("n_tokens")))
    r = packing.audit(bad, docs, "doc_id").first()
    assert r.n_missing == 1 and r.n_over_capacity > 0 and r.n_overlapping > 0


def test_packing_of_nothing(spark):
    assert rows_of(packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), "doc_id")) == []


# --- p9: truncated texts

SUBJECTS = ["The handler", "The parser", "A worker", "The scanner", "The reviewer", "A second report"]
DEEDS = ["copies more bytes than the buffer can hold", "writes the secret to the log when the request fails", "never checks the length of the header", "names the same sink but a different entry point", "stays open until the next run is finished"]


def sentences(rnd, n):
    return " ".join(f"{rnd.choice(SUBJECTS)} {rnd.choice(DEEDS)}." for _ in range(n))


def corpus(seed, n):
    """Whole texts and texts cut inside a word, a few with marks or footers behind the cut."""
    rnd = random.Random(seed)
    docs, cut = [], set()
    for k in range(n):
        text = sentences(rnd, rnd.randint(2, 6))
        if k % 8 == 0:
            words = [m for m in re.finditer(r"[a-z]{4,}", text) if m.start() > 20]
            m = rnd.choice(words)
            text = text[: m.start() + rnd.randint(2, len(m.group()) - 1)] + rnd.choice(["", "...", " [truncated]", "\n\n[imported from board 3]", "\x00"])
            cut.add(k)
        elif k % 8 == 1:
            text += "\n1. parse_a_b -> read_c_d"
        docs.append((k, text, "notes", None))
    return docs, cut


def test_truncated_texts_are_found(spark):
    docs, cut = corpus(6, 800)
    extra = [(9000, None, "notes", "x"), (9001, "", "notes", "x"), (9002, " \n", None, "x"), (9003, "Whole text of a source of its own.", None, "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, source string, core string")
    found = {r.doc_id for r in truncation.truncated(df).collect()}
    assert not found & {9000, 9001, 9002, 9003}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.01 * len(docs)
    report = {r.source: (r.n_documents, r.n_truncated) for r in truncation.report(df).collect()}
    assert report["notes"] == (802, len(found)) and report[""] == (2, 0)


def test_truncated_of_nothing(spark):
    assert rows_of(truncation.truncated(spark.createDataFrame([], "doc_id long, text string, source string"))) == []


LEAD = "The reviewer disagrees with the model because the role check already blocks anonymous callers on each of the tested machines. "
WHOLE = LEAD + "Static analysis marks many further call sites although most of them only pass constants to parse_header_fields and nothing else happens there."


def brute_ends(texts):
    """doc_id: early, by all pairs: whether any copy (similarity 0.8 or more) has a stop where the text ends, else goes on."""
    read = {}
    for doc, text in texts:
        core, cut, end = truncation.closing(truncation.plain(text))
        toks = truncation._found(core)
        words = [(k, t.lower()) for k, t in enumerate(toks) if re.search(r"[^\W]", t)]
        runs = {tuple(w for _, w in words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        read[doc] = (toks, words, runs, end, cut)
    out = {}
    for a, (_, mine, runs, end, cut) in read.items():
        if end == "stop" or cut or len(mine) < 6:
            continue
        tail, last = [w for _, w in mine[-6:-1]], mine[-1][1]
        says = set()
        for b, (toks, words, other, _, _) in read.items():
            if a == b or len(runs & other) < 0.8 * len(runs | other):
                continue
            for k in range(5, len(words)):
                word = words[k][1]
                if [w for _, w in words[k - 5 : k]] == tail and word.startswith(last):
                    rest = [t for t in toks[words[k][0] + 1 :] if t not in truncation._CLOSERS]
                    nxt = rest[0] if rest else "\n"
                    if word != last:
                        says.add(True)
                    elif nxt in truncation._STOP:
                        says.add(False)
                    elif nxt[0] not in "\r\n…" and nxt != "...":
                        says.add(True)
        if says:
            out[a] = min(says)
    return out


def ends_by_bands(spark, texts, **kw):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    read = truncation.read_texts(df.withColumn("source", F.lit("s")), frozenset()).where("doc_id is not null")
    rows = read.select("doc_id", "bands", ((F.col("flag") == "") & (F.col("end") != "stop")).alias("open"))
    return {r.doc_id: r.early for r in truncation.aligned(df, rows, **kw).collect()}


@pytest.mark.parametrize("chunk", [truncation.CHUNK, 1])
def test_near_copies_are_aligned(spark, chunk):
    at = WHOLE.index("_fields")
    texts = [WHOLE, WHOLE[: at - 2], WHOLE[: at + 7], WHOLE + " More text follows here.", WHOLE[:-1], "Quite another text that has nothing in common with the copies it is held agai", "short", ""]
    texts += [f"Note {k}: " + WHOLE.replace("marks", f"marks{k}") for k in range(4)]  # farther copies in the same buckets
    texts = list(enumerate(texts))
    want = brute_ends(texts)
    assert {k: v for k, v in want.items() if k < 4} == {1: True, 2: True} and want[4] is False
    assert ends_by_bands(spark, texts, chunk=chunk) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_recall_of_alignment(spark):
    """Near-copies of real texts: of those whose end brute force decides by a copy, at least 0.9 are decided, all alike."""
    rnd = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 300 and 1500 and doc_id % 5 = 0").collect()]
    texts = list(docs)
    for k, (_, text) in enumerate(docs):
        words = text.split(" ")
        words[len(words) // 3] = f"other{k}"  # a copy with another word, cut somewhere in its last fifth
        copy = " ".join(words)
        texts.append((10**6 + k, copy[: rnd.randint(int(len(copy) * 0.82), len(copy))]))
    texts = [next(g) for _, g in itertools.groupby(sorted(texts, key=lambda x: truncation.closing(truncation.plain(x[1]))[0]), key=lambda x: truncation.closing(truncation.plain(x[1]))[0])]
    want, got = brute_ends(texts), ends_by_bands(spark, texts)
    assert len(want) > 40 and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(want.get(k) == v for k, v in got.items() if k in want and v is False) and sum(want.get(k) == v for k, v in got.items()) >= 0.95 * len(got)


def test_parts_of_the_verdicts(spark):
    docs, _ = corpus(6, 200)
    df = spark.createDataFrame([(k, t, s) for k, t, s, _ in docs] + [(900, WHOLE, "notes"), (901, WHOLE[:-40], "notes"), (902, None, "notes")], "doc_id long, text string, source string")
    by = {r.doc_id: (r.part, r.truncated) for r in truncation.judged(df).collect()}
    assert by[901] == ("copy", True) and by[900][0] == "closing" and 902 not in by
    assert sum(r.n_texts for r in truncation.parts(df).collect()) == len(by)


def test_signatures_estimate_similarity():
    rnd = random.Random(7)
    import numpy as np

    a = np.array([rnd.getrandbits(64) for _ in range(400)], dtype=np.uint64)
    b = a.copy()
    b[:20] = [rnd.getrandbits(64) for _ in range(20)]
    runs = [truncation.shingles(x) for x in (a, b)]
    sigs = truncation.signatures(np.concatenate(runs), np.array([0, len(runs[0])]))
    sets = [set(x.tolist()) for x in runs]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(float((sigs[0] == sigs[1]).mean()) - true) < 0.15
    assert len(truncation.bands(sigs)[0]) == truncation.BANDS


def test_closing_puts_marks_and_footers_aside():
    assert truncation.closing("It is writ...\n\n[imported from board 4]") == ("It is writ", False, "ellipsis")
    assert truncation.closing("It is writ [truncated]") == ("It is writ", True, "bare")
    assert truncation.closing("It is written.\n-- \nsent by desk 4")[2] == "stop"
    assert truncation.closing("It is writ\n" + "[" + "board " * 300 + "]")[0] == "It is writ"
    assert truncation.closing("It is writ\n--\n" + "desk " * 400 + "\n" + "room " * 400)[0] == "It is writ"
    assert Counter(truncation.tokens("took=12ms a_b_c 1.2.3", truncation.Shapes({"took"})))["<n>ms"] == 1


def test_texts_are_read_piece_by_piece():
    rnd = random.Random(14)
    parts = ["src/a_b.c", "took=12ms", "1.2.3.", "deadbeef0123", "x_y-z/", "don't,", "...", ".", "end.\n", "\r\n", " ", "  ", "_", "été", "日本。語", "a" * 60, "\t", "12ab", "z."]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12)))
        vocabulary = truncation.Vocabulary(frozenset())
        assert vocabulary.numbers(text) == [vocabulary[t] for t in truncation._found(text)], text


def test_ascii_texts_are_read_alike():
    rnd = random.Random(12)
    parts = ["src/a_b.c", "took=12ms", "1.2.3", "1.2", "3.", "deadbeef0123", "a" * 60, "x_y-z/", "don't", "...", ". ", ".", "\r\n", " ", "_", "(v2)", "ab12", "12ab", "/", "-"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        assert truncation._ASCII_TOKENS.findall(text) == truncation._TOKENS.findall(text), text
