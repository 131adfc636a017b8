"""Periodic runs, the Merkle manifest and sanitisation against brute force: nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns with the names that the operators use inside."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import manifest, periodic_runs, queries, sanitise
from ledgerloom.llm.common import ship

SF_SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, runs string, hash string, tree string, place string, "
          "size string, digest string, __part string, spans string, copies string, id string, `top` string")


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def table(spark, rows):
    """rows: (doc_id, text[, lang, source, n_chars])"""
    full = [(*r, *[None] * (5 - len(r)), *["x"] * 11) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs

def brute_runs(w, shortest=24, exponent=3):
    """Every period by itself: stretches of places whose word recurs a period later."""
    number, best = {}, {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64)
    for q in range(1, len(w) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if e - s >= max(shortest, exponent * q):
                best.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def sample(r):
    n, letters = r.randint(0, 300), r.choice([1, 2, 3, 40])
    w = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n > 30:
            p, s = r.randint(1, n // 4), r.randrange(n)
            for i in range(s + p, min(n, s + r.randint(p, 4 * p + 30))):
                w[i] = w[i - p]
    return w


def test_runs_of_many_documents():
    r = random.Random(7)
    for _ in range(12):
        docs = [sample(r) for _ in range(20)]
        assert periodic_runs.runs_of(docs) == [brute_runs(d) for d in docs]
    docs = [sample(r) for _ in range(40)]
    assert periodic_runs.runs_of(docs, 30, 4) == [brute_runs(d, 30, 4) for d in docs]


def test_runs_of_long_periodic_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic_runs.runs_of([b, [5] * 900, [k % 200 for k in range(900)]]) == [brute_runs(b), [(0, 900, 1)], [(0, 900, 200)]]
    n = 300_000  # one word, and every period at once, in time n log n
    assert periodic_runs.runs_of([[3] * n]) == [[(0, n, 1)]]


def report(doc_id, text, made):
    """The digest columns by the letter of the contract."""
    w = WORD.findall(text or "")
    if made and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    top = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark):
    r = random.Random(2)
    rows = [(k, " ".join(f"w{x}" for x in sample(r)) + r.choice(["", " \n", " é"])) for k in range(60)]
    rows += [(1, rows[1][1]), (None, "a b " * 40), (None, None), (5, None), (6, ""), (7, " \t\n"), (8, "long " * 60_000), (9, "é" * 5000)]
    docs = table(spark, rows)
    small = [x for x in rows if len(x[1] or "") < 9999]
    got = rows_of(periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periods(table(spark, small)))))
    assert got == sorted((report(*x, True) for x in small), key=str)
    plain = {tuple(x) for x in periodic_runs.find_runs(docs).where("doc_id = 8 and size(runs) > 0").select("collapsed").collect()}
    assert ("long",) in plain
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_runs_query_on_the_given_table(spark):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = rows_of(queries.QUERIES["op11_periodic_runs"](spark, SF_SMALL))
    assert got == sorted((report(*x, True) for x in docs), key=str)


# ---- manifest

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """Levels from the leaves to the one node."""
    levels = [level]
    while len(levels[-1]) > 1:
        up = levels[-1]
        levels.append([sha("".join(up[k:k + 3])) for k in range(0, len(up), 3)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        run = k // 3 * 3
        out.append((level[run:k], level[k + 1:run + 3]))
        k //= 3
    return out


def brute_manifest(rows):
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, (_, _, digest, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = way(trees[s], k) + way(top, j)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for before, after in steps:
                h = sha("".join(before) + h + "".join(after))
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    r = random.Random(4)
    rows = [(k, f"text {k}\nline" * r.randint(0, 3), "en", f"s{min(r.randint(0, 8), 3)}", k) for k in range(120)]
    rows += [(k, "é\n", None, None, None) for k in (3, 3, 5, None, None)] + [(900, None, "de", "ü", 1), (901, "", "", "", 0), (902, "z\n" * 40_000, "x", "Z", 5)]
    rows += [(7, "one", None, "t", 1), (7, "two", None, "t", 1), (7, "one", None, "t", 1)]
    assert rows_of(manifest.documents_manifest(table(spark, rows), height)) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "a\n", None, "s", 1)], [(1, "a", None, "s", 1), (2, "b", None, None, 1)]):
        assert rows_of(manifest.documents_manifest(table(spark, rows), 2)) == brute_manifest(rows)
    assert manifest.documents_manifest(table(spark, []), 2).count() == 0
    leaves = table(spark, [(1, "a", None, "s", 1)]).withColumnRenamed("hash", "leaf")
    rows, sources, root = manifest.manifest(leaves)
    assert root == "x" and sources.collect()[0]["size"] == 1  # a lone leaf is its subroot and the root
    assert set(leaves.columns) < set(rows.columns)


# ---- sanitisation

PATTERNS = {  # the contract's
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def only(v):
    return re.sub("[^0-9]", "", v)


CHECKS = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
          "card": lambda v: 14 <= len(only(v)) <= 19 and luhn(only(v)), "phone": lambda v: 10 <= len(only(v)) <= 15}


def base(text):
    return sorted((m.start(), k, m.end(), kind, m.group()) for k, (kind, p) in enumerate(PATTERNS.items())
                  for m in re.finditer(p, text) if CHECKS[kind](m.group()))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_terms(rows, reach=64, disclosure=0.95, support=3, keep=3):
    """{(id, text): {(start, end): replacement}}"""
    counts = Counter(t for _, x in rows for t in TERM.findall((x or "").translate(LOW)))
    total, near, weight = sum(counts.values()), {}, Counter((i, x or "") for i, x in rows)
    for i, x in weight:
        found = sorted((s, e, kind, v) for s, _, e, kind, v in base(x))
        words = [(m.start(), m.end(), m.group().translate(LOW)) for m in TERM.finditer(x)]
        for k, (s, e, kind, v) in enumerate(found):
            entity = (kind, only(v) if kind in ("card", "phone") else v.translate(LOW))
            low = max([f[1] for f in found[:k]], default=0)
            high = found[k + 1][0] if k + 1 < len(found) else len(x)
            high = max(e, min(high, e + reach)) if low <= e else e
            first = max(low, s - reach)
            sides = [x[max(low, s - reach - 1):s] if low < s else "", x[e:max(e, min(e + reach + 1, found[k + 1][0] if k + 1 < len(found) else len(x)))] if low <= e else ""]
            trimmed = [TERM.sub("", sides[0], count=1) if len(sides[0]) > reach and TERM.match(sides[0]) else sides[0],
                       re.sub(TERM.pattern + r"\Z", "", sides[1]) if len(sides[1]) > reach else sides[1]]
            around = tuple(t.translate(LOW) for t in trimmed)
            for a, b, t in words:
                whole = (a >= first and b <= s) or (a >= e and b <= high)
                if not whole and a < s and b > s and a >= first:  # the mention begins in the term
                    b, whole = s, True
                    t = x[a:s].translate(LOW)
                if not whole and b > e and a < e and b <= high:
                    a, whole = e, True
                    t = x[e:b].translate(LOW)
                if not whole and a < low < b <= s and low > s - reach - 1:  # the one before ends in the term
                    a, whole = low, True
                    t = x[low:b].translate(LOW)
                if not whole and e <= a < high < b and high < e + reach and high < len(x):
                    b, whole = high, True
                    t = x[a:high].translate(LOW)
                if whole:
                    key = (i, x, entity, a, b, t)
                    near[key] = min(near.get(key, around), around)
    own, pairs, seen, classes, class_pairs = Counter(), Counter(), defaultdict(set), Counter(), Counter()
    for (i, x, c, a, b, t), around in near.items():
        own[c] += weight[i, x]
        pairs[c, t] += weight[i, x]
        seen[c, t].add(around)
    for t, n in counts.items():
        classes[t[:keep]] += n
    for (c, t), n in pairs.items():
        class_pairs[c, t[:keep]] += n
    out = defaultdict(dict)
    for (i, x, c, a, b, t) in near:
        if len(seen[c, t]) < support or own[c] >= total or not counts[t]:
            continue

        def share(n, both, c=c):
            return 1 - math.log(n / both) / math.log(total / own[c])

        if share(counts[t], pairs[c, t]) >= disclosure:
            wide = len(t) > keep and share(classes[t[:keep]], class_pairs[c, t[:keep]]) < disclosure
            new = t[:keep] + "*" if wide else ""
            out[i, x][a, b] = min(out[i, x].get((a, b), new), new)
    return out


def brute_report(rows):
    terms = brute_terms(rows)
    out = []
    for i, x in rows:
        found = base(x or "")
        spans = sorted([(s, k, e, kind) for s, k, e, kind, _ in found] + [(a, 4, b, "term") for a, b in terms.get((i, x or ""), {})])
        n = Counter(f[3] for f in found)
        out.append((i, *[n[k] for k in PATTERNS], sha(",".join(f"{f[3]}:{f[0]}:{f[2]}" for f in found)), ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)))
    return sorted(out, key=str)


def pieces(r):
    tough = ["a@b.c", "a@b.com_x@d.org", "x..y%+-@h-1.co.uk.", "a@b", "@b.com", "a@.com", "é@ü.de", "1.2.3.4", "300.1.2.3.4.5.6.7", "1.2.3.4.5.6.7.8.9", "0255.00.1.256",
             "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111", "4111  1111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "00000000000000", "+1 (743) 555-3824",
             "+1((((((((5", "+123456789", "+1 4111 1111 1111 1111", "++49 30 1234567-", "+1.2.3.4 5.6.7.8", "1.2.3.4@5.6.7.8", "\U0001F600", "word", "x1", "-", "\n", "  ", ",", "wörd", "4", "12"]
    return "".join(r.choice(tough) + r.choice(["", " ", " ", "\n", "; "]) for _ in range(r.randint(0, 25)))


def test_mentions(spark):
    r = random.Random(11)
    rows = [(k, pieces(r)) for k in range(400)] + [(None, None), (400, ""), (401, "1.2.3.4 " * 700)]
    long = [(402, "a" * 200_000 + "@"), (403, "1" * 200_000), (404, "a@b" + ".c" * 50_000)]  # the plain patterns take the square of these
    got = {x[0]: [(s["start"], s["kind"], s["end"]) for s in x[1] if s["kind"] < 4] for x in sanitise.find_spans(table(spark, rows + long)).select("doc_id", "spans").collect()}
    assert got == {i: [b[:3] for b in base(x or "")] for i, x in rows} | {402: [], 403: [], 404: [(0, 0, 100_003)]}


def corpus(r):
    names, filler = ["Ada Quill", "Bo Zephyr", "Cy Marlowe"], [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        text = " ".join(r.choice(filler) for _ in range(r.randint(5, 60)))
        if k % 3 == 0:
            j = r.randrange(3)
            who = [f"ada.q@mail{j}.example.com", "+1 (743) 555-3824", "4111 1111 1111 1111"][j]
            text += f" {names[j]}, {who} " + " ".join(r.choice(filler) for _ in range(r.randint(0, 30)))
        rows.append((k, text))
    return rows + [(3, rows[3][1]), (500, "Marble Marlowes Marl " * 9), (None, rows[0][1]), (None, rows[0][1]), (501, None)]


def test_terms_that_reveal(spark):
    rows = corpus(random.Random(3))
    want = brute_terms(rows)
    found = sanitise.find_spans(table(spark, rows))
    got = defaultdict(dict)
    texts = {(i, x or "") for i, x in rows}
    for x in found.collect():
        for s in x["spans"]:
            if s["kind"] == 4:
                got[x["doc_id"], x["hash"]][s["start"], s["end"]] = s["instead"]
    assert sum(map(len, want.values())) > 60 and any(v for d in want.values() for v in d.values()) and any(not v for d in want.values() for v in d.values())
    assert sorted((k[0] is None, k[0] or 0, sorted(v.items())) for k, v in got.items()) == sorted((k[0] is None, k[0] or 0, sorted(v.items())) for k, v in want.items() if v)
    docs = table(spark, rows)
    clean = sanitise.sanitised(docs, found)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for x in clean.collect():
        t = x["text"] or ""
        assert "example.com" not in t and "4111" not in t and "555-3824" not in t and "Zephyr" not in t
        assert x["runs"] == "x" and (x["doc_id"], t) in texts or "<" in t
    assert any(x["text"] is None for x in clean.collect())


def test_sanitise_reports(spark):
    r = random.Random(13)
    rows = corpus(r) + [(1000 + k, pieces(r)) for k in range(40)]
    assert rows_of(sanitise.spans_report(table(spark, rows))) == brute_report(rows)
    assert sanitise.spans_report(table(spark, [])).count() == 0
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op13_sanitise"](spark, SF_SMALL)) == brute_report(docs)
