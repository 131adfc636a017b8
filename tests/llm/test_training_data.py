"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import chat, decontaminate, language_id, license_scan, mixing, near_dedup, quality, suffix_dedup, token_counts, token_output
from ledgerloom.llm.tokens import WordEncoder, encoder, public_path

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _shipped(spark):
    from ledgerloom.llm.common import ship
    ship(spark)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n bigint, part string, `rank` string, size string"


def table(spark, rows):
    """rows: (doc_id, text[, lang, source]); the further columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 7, "p", "r", "s") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words(text):
    return WORD.findall(text or "")


def texts(seed=5):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(60)]
    base = " ".join(r.choice(v) for _ in range(80))
    out = [(1, base), (1, base), (2, base[9:200] + " Tail"), (None, "aa" * 300), (None, None), (5, None), (6, ""), (6, " \t\n"),
           (7, "é " + base[100:260] + " zz"), (8, "abc" * 100), (9, "x"), (9, "x"), (10, "long " * 5000)]
    return out + [(20 + i, " ".join(r.choice(v) for _ in range(r.randint(1, 40)))) for i in range(15)]


def repeats(rows, length):
    got, data = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        got.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if got[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "trigger"), [(20, None), (12, 3)])
def test_repeats_removed(spark, length, trigger):
    rows = [*texts(), (3, texts()[0][1][5:90] + "!!" + texts()[0][1][120:200])]
    got = suffix_dedup.remove_repeats(table(spark, rows), length, trigger)
    assert rows_of(got.drop("kept", "spans")) == repeats(rows, length)


def test_repeats_in_segments(spark, monkeypatch):
    data = np.frombuffer(("abcd" * 30 + "".join(random.Random(1).choice("ab") for _ in range(900))).encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(data, 20, 12), strict=True)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.phrases(data, 20, 12), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_phrases_of_one_trigger_with_like_halves_of_a_hash(spark):
    """Different phrases of one trigger that agree in the upper 32 bits of a hash are no repeats of each other."""
    rng = np.random.default_rng(6)
    some = rng.integers(97, 123, (50_000, 12), dtype=np.uint8)
    least = some[np.argmin(suffix_dedup.Prefix(some.ravel()).windows(12)[::12])]
    data = rng.integers(97, 123, (240_000, 28), dtype=np.uint8)
    data[:, 8:20] = least
    rows = []
    for salt in (0, 1):
        at = np.arange(30_000) * 28
        half = np.concatenate([suffix_dedup.Prefix(x.ravel(), salt).of(at, at + 28) for x in np.split(data, 8)]) >> np.uint64(32)
        order = np.argsort(half)
        same = np.flatnonzero(half[order][1:] == half[order][:-1])
        assert len(same)
        rows += [(len(rows) + k, data[i].tobytes().decode()) for k, i in enumerate(order[np.concatenate([same, same + 1])].tolist())]
    got = suffix_dedup.remove_repeats(table(spark, rows), 20, 12)
    want = repeats(rows, 20)
    assert not any(w[2] for w in want) and rows_of(got.drop("kept", "spans")) == want


def test_many_rows_of_one_id(spark):
    """Rows that share an id, or have none, keep their own repeats."""
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh") for _ in range(24))
    rows = []
    for i in range(3_000):
        x = "".join(r.choice("ijklmnopqrstuvwxyz") for _ in range(r.randint(30, 60)))
        k = r.randrange(len(x))
        rows.append((None if i % 2 else 0, x[:k] + passage + x[k:] if i % 3 else x))
    got = suffix_dedup.remove_repeats(table(spark, rows), 20)
    assert rows_of(got.drop("kept", "spans")) == repeats(rows, 20)


def groups(rows):
    sets = []
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    part = list(range(len(sets)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                part[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), c := least.get(top(k)) if s else i, i == c) for k, (i, s) in enumerate(sets)), key=str)


def test_near_duplicates(spark):
    r, v, rows = random.Random(3), [f"v{i}" for i in range(200)], texts()
    for g in range(6):
        base = [r.choice(v) for _ in range(r.choice([6, 40, 120]))]
        for c in range(8):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(v)
            rows.append((100 * (g + 1) + c, " ".join(x)))
    r.shuffle(rows)
    assert rows_of(near_dedup.near_duplicates(table(spark, rows)).drop("text_hash", "group")) == groups(rows)


def test_near_misses_about_a_group(spark):
    """Copies of one text, many of them too far from most others, some near to a near miss alone."""
    r, rows, seen = random.Random(8), [], []
    base = [f"b{i}" for i in range(160)]
    for c in range(220):
        x = list(r.choice(seen) if seen and c % 3 == 0 else base)
        for _ in range(r.randint(0, 4) if c % 2 else r.randint(2, 9)):
            k = r.randrange(len(x))
            x[k:k + 1] = [] if r.random() < 0.2 else [f"e{r.randrange(4 if c % 5 == 0 else 10**6)}"] * r.randint(1, 2)
        seen.append(x)
        rows.append((c, " ".join(x)))
    want = groups(rows)
    assert len({x[2] for x in want}) > 10
    assert rows_of(near_dedup.near_duplicates(table(spark, rows)).drop("text_hash", "group")) == want


def test_a_long_word_leaves_the_other_runs_alike(monkeypatch):
    """A run longer than a segment is hashed in another way, the other runs of its text are not."""
    r = random.Random(11)
    v = [f"a{r.randrange(10**6)}" for _ in range(400)]
    plain, with_long = (" ".join(x).encode() for x in (v, [*v[:200], "Q" * 300, *v[200:]]))
    want = [near_dedup.shingles(x, 5) for x in (plain, with_long)]
    assert len(np.intersect1d(*want)) == 392
    monkeypatch.setattr(near_dedup, "SEGMENT", 120)
    got = [near_dedup.shingles(x, 5) for x in (plain, with_long)]
    assert [len(x) for x in got] == [396, 397] and len(np.intersect1d(*got)) == 392
    assert np.array_equal(got[0], want[0]) and len(np.intersect1d(got[1], want[1])) == 392
    only = near_dedup.shingles(b"Q" * 300, 5)
    assert len(only) == 1 and np.array_equal(only, near_dedup.shingles(b"q" * 300, 5))


def test_pipeline_keeps_one_of_documents_at_four_fifths(spark):
    r = random.Random(12)
    rows, sets, part = [], [], []
    for g in range(12):
        base = [f"g{g}x{k}" for k in range(204)]
        for c in range(6):
            x = list(base)
            for k in r.sample(range(5, 200, 6), (0, 4, 4, 5, 2, 3)[c]):
                x[k] = f"n{r.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(x)))
            sets.append({tuple(x[k:k + 5]) for k in range(200)})
            part.append(len(part))
    some = 0
    for a in range(len(sets)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            some += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either:
                part = [part[b] if p == part[a] else p for p in part]
    assert some > 10
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, i), i)
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(least.values())


def test_sketch_fills_every_bin():
    for n in (1, 2, 7, 1000):
        s = near_dedup.sketch(np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)), 128)
        assert len(s) == 128 and len(set(s.tolist())) <= max(n, 1)


def test_mix(spark):
    rows = [(i, t, None, s) for (i, t), s in zip(texts(), ["b", "a", None, "c", "b", "b", "a", None, "a", "b", "c", "d", "b"] * 3, strict=False)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    again = mixing.mix_sources(table(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted((s for s in size if s is not None)) + [None])}
    total, target, capped = sum(size.values()), {}, set()
    while True:
        share = (total - sum(3 * size[s] for s in capped)) / (sum(weight[s] for s in size if s not in capped) or 1)
        target = {s: 3 * size[s] if s in capped else share * weight[s] for s in size}
        more = {s for s in size if target[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    out = mixing.emit(table(spark, rows), mixing.mix_sources(table(spark, rows)))
    assert out.count() == sum(r["copies"] for r in got) and out.columns == table(spark, rows).columns


def test_quality(spark):
    rows = [*texts(), (50, "a b c a b c x\n#$ y\n#$ y\n \n \n"), (51, "k " * 80), (52, "one two"), (53, "a a a"), (54, "a a a a")]
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(table(spark, rows)).collect()}
    for i, t in rows:
        t, w = t or "", words(t)
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[(i, len(w))]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_bad_host_takes_its_documents_with_it(spark):
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "bad", None, "junk") for i in range(100)] + [(200 + i, good, None, f"s{i % 4}") for i in range(40)]
    kept = {r["doc_id"] for r in quality.judge(table(spark, rows)).where("kept").collect()}
    assert kept == set(range(200, 240))
    assert {r["doc_id"] for r in quality.judge(table(spark, rows), keep_rows=True).collect()} == kept


def distance(p, t):
    before = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_myers():
    r = random.Random(2)
    for _ in range(150):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (12, 40))
        assert decontaminate.myers(p, t)[0] == distance(p, t)


def test_leaks(spark):
    r = random.Random(4)
    item = "".join(r.choice("abcdefgh ") for _ in range(100)).strip()
    near, far = item[:20] + "X" + item[22:60] + item[63:], "".join(c if r.random() < 0.7 else "-" for c in item)
    rows = [*texts(), (70, "so " + item.upper() + " end"), (71, "pre" + near), (72, far), (73, item[:40]), (None, item)]
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "nowhere to be found at all")], "item_id long, text string")
    got = rows_of(decontaminate.find_leaks(table(spark, rows), bench).select("doc_id", "item_id", "distance"))
    want = [(i, 1, distance(item, (t or "").translate(LOW))) for i, t in rows if t and distance(item, t.translate(LOW)) <= 8]
    assert got == sorted(want, key=str) and {g[0] for g in got} == {70, 71, None}
    blocks = rows_of(decontaminate.find_leaks(table(spark, rows), bench, block_chars=30).select("doc_id", "item_id", "distance"))
    assert blocks == got
    clean = decontaminate.without_leaks(table(spark, rows), bench)
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(i) for i, t in rows if i not in (70, 71) and t != item)
    assert decontaminate.find_leaks(table(spark, rows), bench.limit(0)).count() == 0


def passages(item, text, rate=0.08):
    return sorted((start, end, d) for _, start, end, d in decontaminate.Items([(1, item)], rate).matches(text))


def test_each_of_adjoining_copies_is_a_passage():
    r = random.Random(9)
    item = "".join(r.choice("abcdefgh ") for _ in range(98)) + "yz"
    near, short = item[:50] + "X" + item[51:], item[:40] + item[41:]
    assert passages(item, item * 3) == [(0, 100, 0), (100, 200, 0), (200, 300, 0)]
    assert passages(item, item + " " + short) == [(0, 100, 0), (101, 200, 1)]
    assert passages(item, near + item + near) == [(0, 100, 1), (100, 200, 0), (200, 300, 1)]
    assert passages(item, "-" * 30 + near + near + short + "-" * 30) == [(30, 130, 1), (130, 230, 1), (230, 329, 1)]
    listed = "one, two, three, four, five, " * 4
    assert passages(listed, "see " + listed * 5 + "end") == [(4 + k * len(listed), 4 + (k + 1) * len(listed), 0) for k in range(5)]


def test_nothing_within_the_budget_is_left_beside_passages():
    r = random.Random(10)
    for _ in range(150):
        item = "".join(r.choice("ab") for _ in range(r.randint(13, 30)))
        text = "".join(item[:k] + r.choice(["", "a", "c"]) + item[k + 1:] + "c" * r.choice([0, 0, 1, 9]) for k in (r.randrange(len(item)) for _ in range(6)))
        got, budget = passages(item, text), int(len(item) * 0.08)
        free = list(text)
        for a, b, d in got:
            assert decontaminate.distances(item, text[a:b], anchored=True)[-1] == d <= budget
            free[a:b] = "\n" * (b - a)
        assert all(distance(item, x) > budget for x in "".join(free).split("\n") if x)


def whole_ids(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]


TRICKY = ["a  b", " lead", "trail ", "tab\t x", "it's we'll\n\n end", "x<|endoftext|>y <|endoftext|> z", "#a ## #", "ä ö  ü", "\n", "a\x1c b", "日本 語"]


def test_word_cache_gives_the_ids_of_whole_texts():
    got = encoder("byte_bpe_50k.json").encode(TRICKY)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids for _, ids in whole_ids([(0, t) for t in TRICKY])]


def test_token_files(spark):
    rows = texts() + [(300 + k, t) for k, t in enumerate(TRICKY)]
    got = token_output.encode_to_files(table(spark, rows), shard_tokens=500).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = Counter((i, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4"))) for i, x in whole_ids(rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert token_output.encode_to_files(table(spark, []).limit(0)).count() == 0


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(1)
    texts_ = [np.tile(r.integers(3, 40, 9), 30)[:n].astype("<u2") for n in (0, 1, 50, 270)] + [np.array([2, 5, 2, 2, 7], "<u2")]
    shard = token_output.Shard(token_output.pack([4, None, 5, 6, 7], [t.tobytes() for t in texts_], np.dtype("<u2"), 2, 100))
    assert len(shard.rules) and shard.ids == [4, None, 5, 6, 7]
    for i, t in enumerate(texts_):
        assert shard.document(i).tolist() == [*t.tolist(), 2]
    assert shard.document(3, 100, 130).tolist() == texts_[3][100:130].tolist()


def test_token_counts(spark, tmp_path):
    rows = texts()
    got = token_counts.counts_by_document(table(spark, rows)).select("doc_id", "n_tokens")
    assert rows_of(got) == sorted(((i, len(x) + 1) for i, x in whole_ids(rows)), key=str)
    flat = np.array([5, 6, 9, 9, 7, 7, 7, 7, 7, 9, 8], "<u2")  # ends across blocks, and none behind the last
    (tmp_path / "tokens-a.bin").write_bytes(flat.tobytes())
    for block in (1, 2, 3, 4, 100):
        found = token_counts.count_tokens(spark, f"file://{tmp_path}", 9, block_tokens=block).orderBy("number").collect()
        assert [(r["start"], r["n_tokens"]) for r in found] == [(0, 3), (3, 1), (4, 6), (10, 1)]


def test_token_counts_of_texts_with_the_end_literal(spark):
    rows = texts() + [(300 + k, t) for k, t in enumerate(TRICKY)] + [(320, "<|endoftext|>"), (321, "a <|endoftext|> b")]
    got = token_counts.counts_by_document(table(spark, rows)).select("doc_id", "n_tokens")
    assert rows_of(got) == sorted(((i, len(x) + 1) for i, x in whole_ids(rows)), key=str)


def test_chats(spark):
    convs = {1: "ab", 2: "abc", 3: "abc", 4: "b", 5: "abd", 6: "a", None: "ba"}
    rows = [(c, k, "user" if k % 2 == 0 else None, x) for c, t in convs.items() for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.format_chats(df).orderBy("conv_id", "place").collect()
    assert {r["conv_id"] for r in got} == {None, 2, 5}  # 4 is the start of the null conversation
    assert "".join(r["rendered"] for r in got if r["conv_id"] == 2) == "<|user|>\na\n<|end|>\n<||>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_licenses(spark):
    a = license_scan.compile_template("one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;words=1-2>> end")
    for text, ok in (("one x end", 1), ("one two x y end", 1), ("one two three x end", 1), ("one three x z end", 0), ("one end", 0), ("one x y", 0)):
        assert a.accepts_at(text.encode().split(), 0) == bool(ok), text
    rows = [*texts(), (80, "CC-BY cc by! General\nPublic LICENSE, cc byé"), (81, "This work is licensed under the GNU General Public License, version 3."),
            (82, "Released under the MIT Licence."), (83, "Released under the MIT License."), (84, "All rights reserved all rights reserved")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert (got[80]["n_base"], got[80]["first_word"], got[80]["last_word"], got[80]["base_labels"]) == (3, 0, 4, "cc-by,gpl")
    assert got[81]["labels"] == "gpl,gpl-3.0" and got[82]["labels"] == "" and got[83]["labels"] == "mit"
    assert got[84]["n_base"] == 2 and got[84]["score"] == 0.5 and got[6]["first_word"] is None


def test_languages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.where(~odd))
    held = docs.where(odd)
    right = language_id.identify(held, model).join(held, "doc_id").where("lang = lang_pred").count()
    assert right >= 0.95 * held.count()
    strange = language_id.identify(table(spark, [(1, None), (2, ""), (3, "12 !"), (None, "the")]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in strange.collect() if r["doc_id"]} == {1: "und", 2: "und", 3: "und"}
    none = language_id.fit(docs.where("lang = 'none'"))
    assert language_id.identify(held, none).where("lang_pred <> 'und'").count() == 0
    long = "the quick " * 300_000
    assert np.array_equal(language_id.counts(long) > 0, language_id.counts(long[:1000] + " the quick") > 0)


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    for fn in (suffix_dedup.remove_repeats, near_dedup.near_duplicates, mixing.mix_sources, quality.judge, license_scan.scan_licenses, token_counts.counts_by_document):
        assert fn(none).count() == 0


# ---- names that the operators use inside, ties, id types, nested regions

#: Columns that a caller's table may have; each is a name that some operator uses inside.
CLASHES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "copies", "copy", "row", "hash", "place",
           "number", "rank", "size", "taken", "target", "__id", "__h", "__th", "__copies", "__number", "__words", "id", "th", "n", "host", "rest", "c0", "part"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("lang"), F.lit("-"))) for c in CLASHES}).withColumn(
        "tags", F.create_map(F.lit("k"), F.col("lang")))


def prose(r, n):
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


def clash_rows():
    r = random.Random(6)
    rows = [(k, prose(r, r.randint(60, 90)), f"l{k}", f"s{k % 3}", k) for k in range(30)]
    return rows + [(31, rows[0][1], "l0", "s0", 1), (32, rows[1][1], "b", "s1", 1), (32, rows[1][1], "a", "s1", 2), (33, None, "n", None, 0), (34, "", "e", "s1", 0)]


def test_stages_keep_columns_of_any_name(spark):
    rows = clash_rows()
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name == "benchmark decontamination":
            items = spark.createDataFrame([("i1", rows[5][1][:120])], "item_id string, text string")
            out = decontaminate.without_leaks(docs, items)
        else:
            out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got, name
        for x in got:
            assert all(x[c] == f"own {c} {x['lang']}" for c in CLASHES), name
            assert (x["doc_id"], x["text"]) in {(a[0], a[1]) for a in rows} and x["tags"] == {"k": x["lang"]}
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_equal_ids_are_emitted_alike(spark):
    rows = [(1, "a b c", x, "s", k) for k, x in enumerate("pqrstuvw")] + [(2, "d", "z", "t", 1)]
    outs = []
    for n in (1, 3, 7):
        docs = clashing(spark, rows).repartition(n)
        outs.append(rows_of(mixing.emit(docs, mixing.mix_sources(docs)).select("doc_id", "lang")))
    assert outs[0] == outs[1] == outs[2]
    starts = []
    for n in (1, 5):
        docs = spark.createDataFrame([(7, f"text {k} " * (1 + k % 4)) for k in range(60)], "doc_id long, text string").repartition(n)
        starts.append(rows_of(token_output.encode_to_files(docs).select("start", "n_tokens", "ids_crc32")))
    assert starts[0] == starts[1]


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint", "string", "date", "decimal(9,2)"])
def test_item_ids_of_any_type(spark, kind):
    text = "one two three four five six seven eight nine ten"
    value = "date '2020-02-03'" if kind == "date" else f"cast(7 as {kind})"
    items = spark.sql(f"select {value} as item_id, '{text}' as text, 1 as start, 2 as distance")
    docs = spark.createDataFrame([(1, f"x {text} y", 5), (2, "none", 6)], "doc_id long, text string, distance int")
    for docs_of in (docs, docs.withColumn("doc_id", docs["doc_id"].cast("string"))):
        got = decontaminate.find_leaks(docs_of, items)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
        assert [tuple(x)[2:] for x in got.collect()] == [(2, 2 + len(text), 0)]


def accepts(words, template):
    return license_scan.scan_text(" ".join(words).encode(), (("t", template),), (("no phrase", "p"),))[5] == "t"


def test_templates_against_all_readings():
    opened, shut = "<<beginOptional>>", "<<endOptional>>"
    nested = f"alpha {opened}b {opened}d{shut} longoptionalword{shut} end"
    assert accepts(["alpha", "end"], nested) and accepts("alpha b longoptionalword end".split(), nested)
    assert accepts("x alpha b d longoptionalword end y".split(), nested) and not accepts("alpha b end".split(), nested)
    assert accepts("q r beta".split(), "<<var;words=1-2>> beta") and not accepts(["beta"], "<<var;words=1-2>> beta")
    with pytest.raises(ValueError, match="no region"):
        accepts(["a"], f"{opened}a{shut} <<var;words=1-2>>")
    r = random.Random(9)

    def part(depth):  # a markup and all that it reads
        kind = r.randrange(4 if depth else 2)
        if kind < 2:
            w = r.choice("abc")
            return w, {(w,)}
        markup, reads = zip(*[part(depth - 1) for _ in range(r.randint(1, 2))], strict=True)
        if kind == 2:
            least = r.randint(0, 1)
            return f"<<var;words={least}-1>>", {(x,) for x in ("key", *"abcd")} | ({()} if not least else set())
        every = {()}
        for x in reads:
            every = {a + b for a in every for b in x}
        return f"{opened}{' '.join(markup)}{shut}", every | {()}

    for _ in range(60):
        markup, reads = zip(*[part(2) for _ in range(r.randint(1, 3))], strict=True)
        every = {("key",)}
        for x in reads:
            every = {a + b for a in every for b in x}
        for _ in range(30):
            words = [r.choice(["key", "a", "b", "c", "d"]) for _ in range(r.randint(1, 7))]
            want = any(tuple(words[i:i + len(e)]) == e for e in every for i in range(len(words)))
            assert accepts(words, "key " + " ".join(markup)) == want, (markup, words)


def test_pairs_stay_a_multiple_of_members(spark, monkeypatch):
    counted = []

    def close(*args, plain=near_dedup._close):
        out = plain(*args)
        counted.append(out.count())  # beside them there is a pair a member and bucket
        return out

    monkeypatch.setattr(near_dedup, "_close", close)
    per_member = {}
    for n in (40, 80):
        r = random.Random(n)
        core, extra = [f"c{k}" for k in range(400)], [f"e{k}" for k in range(60)]
        rows = [(0, " ".join(core))]
        for k in range(1, n):
            w = list(core)
            w[r.randrange(400)] = f"x{k}"
            rows.append((k, " ".join(w)))
        for k in range(n, 2 * n - 1):
            w = core[:200] + extra + core[200:] + [f"y{k}-{j}" for j in range(45)]  # 0.84 alike, by the same insertion
            rows.append((k, " ".join(w)))
        counted.clear()
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
        got = {x["doc_id"]: x["component_id"] for x in found.collect()}
        sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
        top = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    old, new = max(top[a], top[b]), min(top[a], top[b])
                    top = {k: new if v == old else v for k, v in top.items()}
        assert got == top
        per_member[n] = sum(counted) / len(rows)
    assert per_member[80] <= 1.5 * per_member[40] + 0.1 and per_member[80] < 4, per_member


def test_recall_of_the_buckets(spark):
    r, rows, links = random.Random(31), [], []
    for k in range(300):
        n = r.randint(11, 300)
        a = [f"p{k}-{j}" for j in range(n)]
        b = a[max(1, n // 14):] if n < 40 else [*a[:n // 2], f"q{k}", *a[n // 2 + 1:]]
        x, y = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (a, b)]
        if 100 * len(x & y) >= 85 * len(x | y):
            links.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert len(links) > 150
    found = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[b] == a for a, b in links)


def test_pipeline_from_end_to_end(spark, tmp_path):
    r = random.Random(12)
    rows = [(k, prose(r, r.randint(60, 120)), "en", f"s{k % 2}", 5) for k in range(40)]
    item = prose(r, 30)
    rows += [(40, rows[0][1], "en", "s1", 5), (41, rows[2][1] + " tail", "en", "s0", 5), (42, f"{rows[3][1][:200]} {item} {prose(r, 50)}", "en", "s1", 5),
             (43, "too short", "en", "s0", 5), (44, None, "en", "s1", 5)]
    docs = clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([("i", item), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    kept = [x for x in rows if x[0] < 40]
    sizes = Counter()
    for x in kept:
        sizes[x[3]] += len(words(x[1]))
    assert {x["doc_id"] for x in got} <= set(range(40)) and {x["doc_id"] for x in got} >= {x[0] for x in kept if x[3] == "s1"}
    total = sum(sizes.values())
    taken = Counter()
    text = {x[0]: x for x in kept}
    encode = encoder("byte_bpe_50k.json")
    before = 0
    for x in sorted(got, key=lambda x: x["start"]):
        i = x["doc_id"]
        taken[text[i][3]] += len(words(text[i][1]))
        ids = [*encode.tokenizer.encode(text[i][1], add_special_tokens=False).ids, 2]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        before += len(ids)
    assert abs(taken["s0"] - total / 3) < 200 and abs(taken["s1"] - 2 * total / 3) < 200
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_word_cache_encodes_as_the_library_does():
    """White space of all kinds, marks, contractions, letters of several scripts and the vocabulary's added token."""
    encode, r = encoder("byte_bpe_50k.json"), random.Random(3)
    parts = ["a", "b", "The", "rend", "'s", "'", "n't", ".", ",", "<", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\r\n", "\t", "é", "ß", " ", "　",
             "\x1c", "\x85", "中", "1", "42", "²", "ª", "_", "-", "́", "😀", "İ", "ʰ", "\x00", "ſ", "…"]
    made = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(5000)]
    got = [t for at in range(0, len(made), 500) for t in encode.encode(made[at:at + 500])]
    whole = encode.tokenizer.encode_batch_fast(made, add_special_tokens=False)
    assert got == [np.array(e.ids, dtype=encode.dtype).tobytes() for e in whole]


def test_hosts_that_differ_by_chance_are_judged_as_one(spark):
    """Small hosts of one rate of failures, 30 %: some have more than half by chance, none is to go for that."""
    good, r = " ".join(f"g{i}" for i in range(60)), random.Random(3)
    rows = [(i, "bad" if r.random() < 0.3 else good, None, f"h{i // 4}") for i in range(800)]
    judged = quality.judge(table(spark, rows)).collect()
    worst = {rows[x["doc_id"]][3]: x["host_rate"] for x in judged}
    observed = Counter(rows[x["doc_id"]][3] for x in judged if x["base_failed"])
    assert max(observed.values()) >= 3 and max(worst.values()) < 0.5 and not any(x["host_failed"] for x in judged)


def test_sample_of_languages(spark):
    """The same rows whatever the partitions; repeated rows count each; never more than asked for; classes against brute force."""
    rows = [(i % 40, f"text {i % 25} of words", None, None) for i in range(300)]
    df = spark.createDataFrame([(i, t, "a" if i % 3 else "b") for i, t, *_ in rows], "id long, text string, lang string")
    got = [sorted(map(tuple, language_id._sample(df.repartition(n), 30).collect())) for n in (1, 5)]
    assert got[0] == got[1] and Counter(x[0] for x in got[0]) == {"a": 30, "b": 30}
    few = [sorted(map(tuple, language_id._sample(df.where(f"id < {n}"), 1000).collect())) for n in (3, 40)]
    assert [len(x) for x in few] == [df.where("id < 3").count(), 300]


def test_nearest_centroids_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang is not null")
    model = language_id.fit(docs, sample=20, clusters=3)
    texts_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert Counter(model.languages).most_common(1)[0][1] <= 3
    for i, text in texts_of.items():
        c = language_id.counts(text or "")
        if c is None:
            assert got[i]["lang_pred"] == "und"
            continue
        v = [(1 + np.log(n)) * w if n else 0.0 for n, w in zip(c.tolist(), model.idf.tolist(), strict=True)]
        length = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * y for x, y in zip(v, centre, strict=True) if x) / length for centre in model.centroids.tolist()]
        best = max(cosines)
        assert abs(got[i]["score"] - best) < 1e-4
        assert got[i]["lang_pred"] in {lang for lang, x in zip(model.languages, cosines, strict=True) if x > best - 1e-4}


def test_whole_licenses_and_their_score(spark):
    def plain(markup, name):
        markup = re.sub(r"<<(begin|end)Optional>>", " ", markup)
        return re.sub(r"<<var;words=\d+-(\d+)>>", lambda m: " ".join([name] * int(m[1])), markup)

    for label in ("mit-whole", "isc-whole", "bsd-2-clause-whole", "bsd-3-clause-whole", "zlib-whole", "apache-2.0-header"):
        whole = plain(license_scan.TEMPLATES[label], "holders")
        got = license_scan.scan_text(f"Some words. {whole}, and others.".encode())
        assert label in got[5].split(",") and got[6] == 1.0, label
        words_of = whole.split()
        for cut in (words_of[:-1], words_of[1:], [*words_of[:50], "other", *words_of[51:]]):
            assert label not in license_scan.scan_text(" ".join(cut).encode())[5].split(",")
    assert license_scan.scan_text(b"released under the MIT License")[6] == 0.5 + 5 / 6 / 2
    assert license_scan.scan_text(b"released under the MIT License. It is released under the MIT License")[6] == 1.0

    rows = [("x", "alpha <<var;words=0-2>> beta"), ("y", "gamma"), (None, "delta"), ("x", "alpha <<var;words=0-2>> beta")]
    templates = license_scan.templates_of(spark.createDataFrame(rows, "label string, markup string"))
    got = license_scan.scan_licenses(table(spark, [(1, "alpha of beta"), (2, "gamma"), (3, "alpha gamma b"), (4, "delta")]), templates, {})
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got.collect()} == {1: ("x", 0.5 + 3 / 8), 2: ("y", 1.0), 3: ("y", 1.0), 4: ("", 0.0)}
    assert license_scan.templates_of(spark.createDataFrame([], "label string, markup string")) == {}
    assert license_scan.scan_text(b"delta", (), ())[5] == ""
    with pytest.raises(ValueError, match="several"):
        license_scan.templates_of(spark.createDataFrame([*rows, ("x", "other")], "label string, markup string"))
    with pytest.raises(ValueError, match="characters"):
        license_scan.templates_of(spark.createDataFrame(rows, "label string, markup string"), most_chars=5)


def test_license_phrases_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split()]
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["base_labels"]) == (len(w), len(places), ",".join(sorted({label for _, label in places})))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= x["score"] <= 1 and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(","))


@pytest.mark.parametrize("kind", ["<u4", "<u8"])
def test_places_of_pairs_are_those_of_a_search(kind):
    """More pairs than the hashed table keeps apart, and keys that share a place with one of them."""
    rnd = np.random.default_rng(7)
    chosen = np.unique(rnd.integers(0, 1 << 32, 60_000).astype(kind))
    key = np.concatenate([rnd.choice(chosen, 50_000), rnd.integers(0, 1 << 32, 200_000).astype(kind), chosen[-1:]])
    near, place = token_output._places(key, chosen)
    assert np.array_equal(near, np.flatnonzero(np.isin(key, chosen))) and np.array_equal(chosen[place], key[near])
    one = token_output._places(key, chosen[:1])
    assert np.array_equal(one[0], np.flatnonzero(key == chosen[0])) and not one[1].any()


def test_the_ids_of_a_chunk_are_gathered_together(monkeypatch):
    texts = [f"text {k}, of\nsome words  and {'more ' * (k % 5)}" for k in range(300)] + ["", "one", " \n ", "a  b"]
    e = WordEncoder("byte_bpe_50k.json")
    e.encode(texts)  # learns the words
    calls, plain = [], e._gather
    monkeypatch.setattr(e, "_gather", lambda numbers: (calls.append(len(numbers)), plain(numbers))[1])
    assert e.encode(texts) == e._encode(texts) and len(calls) < 5
    assert e.encode(["", "word"]) == e._encode(["", "word"]) and e.encode([]) == []
