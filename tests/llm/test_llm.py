"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated
rows and extra columns; and the registered queries over the smallest supplied tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import ann, chat, jaccard, language, leaks, mixing, pages, pii, sharding, tokens
from tidemill.llm.components import components
from tidemill.llm.queries import END_ID, ORACLES, QUERIES, TOKENIZER, table
from tidemill.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [
    (0, BASE),
    (1, BASE.upper()),
    (2, BASE + " phi"),
    (3, "prefix " + BASE),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "two words"),
    (8, "Two words"),
    (9, "two  WORDS"),
    (10, LONG),
    (11, LONG + " end"),
    (12, "été ß İ 😀 don't. <|endoftext|> H̱x 10.50!"),
    (12, "été ß İ 😀 don't. <|endoftext|> H̱x 10.50!"),
    (None, BASE),
    (13, "a " * 500),
]


def frame(spark, rows=TEXTS):
    """Extra columns carry names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, node long, size string")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_tokens_round_trip(spark):
    docs = frame(spark)
    folder = scratch_path(spark, "test-tokens")
    manifest = tokens.write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID, length=64)
    got = sorted(map(tuple, tokens.read_documents(spark, folder, manifest).collect()), key=lambda r: r[1])
    encoder = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, every, expected = 0, [], []
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [END_ID]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every.append(ids)
    assert got == expected
    for row in manifest.collect():
        file = tokens.TokenFile(folder, row["ids_file"], row["docs_file"])
        sequence, mask = file.sequence(0)
        assert len(sequence) == len(mask) == 64 and not sequence.flags.owndata
        last = (row["n_tokens"] - 1) // 64
        assert sum(file.sequence(last)[1].to_pylist()) == (row["n_tokens"] - 1) % 64 + 1


def test_tokens_of_nothing(spark):
    folder = scratch_path(spark, "test-tokens")
    manifest = tokens.write_token_files(frame(spark).limit(0), folder, public_tokenizers.path(TOKENIZER), END_ID)
    assert tokens.read_documents(spark, folder, manifest).count() == 0


def sets_of(rows):
    out = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_components(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    lowest = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(a)] = min(lowest.get(root(a), i), i)
    return sorted(((i, len(s), lowest.get(root(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard_brute_force(spark):
    got = sorted(map(tuple, jaccard.linked_components(frame(spark)).collect()), key=str)
    assert got == brute_components(TEXTS)


def test_jaccard_chains_and_near_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for g in range(4):
        words = [f"{w}{g % 2}" for w in base]
        for k in range(60):
            own = list(words)
            for p in rng.integers(0, 60, rng.integers(0, 4)):
                own[p] = f"x{rng.integers(0, 9)}"
            rows.append((1000 * g + k, " ".join(own)))
    for k in range(40):  # a drifting chain
        rows.append((9000 + k, " ".join(f"c{i}" for i in range(k, k + 40))))
    got = sorted(map(tuple, jaccard.linked_components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 7)
    test_jaccard_chains_and_near_groups(spark)


def test_jaccard_keeps_one_of_each_group(spark):
    kept = [r["doc_id"] for r in jaccard.one_of_each_group(frame(spark)).collect()]
    assert sorted(i for i in kept if i is not None) == [0, 4, 5, 6, 7, 8, 10, 12, 13]
    assert jaccard.one_of_each_group(frame(spark)).columns == frame(spark).columns
    assert jaccard.linked_components(frame(spark).limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), *[(100, k) for k in range(101, 160)], *[(k, k + 1) for k in range(200, 240)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[9] == 1 and got[6] == 5 and 7 not in got
    assert {got[k] for k in range(100, 160)} == {100} and {got[k] for k in range(200, 241)} == {200}


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((600, 16))
    points[100:160] = points[100]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] + [1.0] * 15), (1300, [None] + [1.0] * 15), (None, [1.0] * 16), (1400, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, block string")
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        apart = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(600), apart)) if i != q][:10]
        hits += len(set(best) & {i for i, _ in found})
        assert [s for _, s in found] == sorted(s for _, s in found) and all(abs(apart[i] - s) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 60
    assert [i for i, _ in got[100]] == list(range(101, 111))
    assert ann.nearest_neighbours(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id < 3"), F.col("id") == 0).count() == 2


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    test_neighbours_brute_force(spark)


def test_flow_for_overlapping_sources():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 14}, 2)
    assert sum(flow[p].get("a", 0) for p in flow) == 12 and sum(flow[p].get("b", 0) for p in flow) == 14
    assert sum(flow[("a", "b")].values()) <= 20 and flow[("a",)]["a"] == 10  # repeats only where needed
    used = {p: sum(g.values()) for p, g in flow.items()}
    assert sum(max(0, used[p] - s) for p, s in {("a",): 10, ("a", "b"): 10, ("b",): 2}.items()) == 4


def test_targets():
    got = mixing.capped_targets({"a": 10, "b": 100, "c": 50}, {"a": 3, "b": 1, "c": 2}, 1.5, 2)
    assert got["a"] == 20 and abs(sum(got.values()) - 240) < 1e-9 and got["c"] <= 100
    assert mixing.capped_targets({}, {}, 1.5, 2) == {}


def test_mixing_rows(spark):
    docs = frame(spark, TEXTS + [(50 + k, "word " * (k % 7)) for k in range(300)])
    taken, targets, sizes = mixing.by_one_source(docs)
    rows = taken.collect()
    assert len(rows) == len(TEXTS) + 300 and all(0 <= r["copies"] <= 2 for r in rows)
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    by = collections.Counter()
    for r in rows:
        by[r["members"][0]] += r["size"] * r["copies"]
    for s, t in targets.items():
        assert abs(by[s] - t) <= max(r["size"] for r in rows if r["members"][0] == s) / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.by_one_source(docs)[0].collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    # Rows without an id, and rows that repeat one, come as often as they are taken.
    as_taken = collections.Counter((r["doc_id"], r["members"][0], r["size"]) for r in rows for _ in range(r["copies"]))
    assert collections.Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in mixed.collect()) == as_taken
    assert any(i is None for i, _, _ in as_taken) and any(i == 12 for i, _, _ in as_taken)
    clash = docs.withColumns({"_alike": F.lit(1), "_nth": F.lit("x")})
    assert mixing.mixed_rows(clash).count() == sum(as_taken.values()) and mixing.mixed_rows(docs.limit(0)).count() == 0
    assert mixing.by_one_source(docs.limit(0))[0].count() == 0


def test_mixing_of_overlapping_members(spark):
    docs = spark.createDataFrame([(k, "w " * 5, ["a"] if k % 3 else ["a", "b", "b"]) for k in range(300)] + [(900, "w", None), (901, "w", [])], "doc_id long, text string, of array<string>")
    out, _ = mixing.mix(docs, F.col("of"), lambda sizes: {"a": 1200, "b": 600}, passes=2)
    got = collections.Counter()
    for r in out.collect():
        assert set(r["taken_for"] or []) <= set(r["members"])
        for s in r["taken_for"] or []:
            got[s] += r["size"]
    assert abs(got["a"] - 1200) <= 5 and abs(got["b"] - 600) <= 5


def base_spans(t):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn % 10 == 0) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    None, "", "a@b.c_d@e.f", "x" * 60_000 + "@y", "1" * 60_000, "1 " * 30_000, "é😀 1.2.3.4 ok 300.1.1.1 and 1.2.3.4.5.6.7.8", "+1 (017) 555-7713 +1 2",
    "4111 1111 1111 1111, 4111-1111-1111-1111.", "a@b a@b.co, .@a.b..@c.d", "00000255.1.1.1", "+49 30 1234567 x +49.30.", "@@a@b.c@d.e", "9" * 20 + " 4111111111111111",
]


def test_personal_data(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(PRIVATE)] + [(None, "a@b.co", "x", 1)], "doc_id long, text string, kind string, row int")
    rows = pii.personal_data(df).collect()
    assert len(rows) == len(PRIVATE) + 1
    for r in rows:
        expected = base_spans(PRIVATE[r["doc_id"]]) if r["doc_id"] is not None else ["email:0:6"]
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(r["spans"].split(",")) | {""}
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in expected) for k in pii.KINDS]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    known = [(k, f"please call +49 30 55{k:05d} today") for k in range(20)]
    unseen = [(100, "please call 030/5512345 today"), (101, "in room 2024/12345 we met")]
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    valid = [str(n) for n in range(4111111111111120, 4111111111111260) if luhn(str(n))][:12]
    cards = [(200 + k, f"card number {n} expires") for k, n in enumerate(valid)]
    odd = [(300, "card number 4111111111111112 expires"), (301, "order number 4111111111111112x shipped")]
    df = spark.createDataFrame(known + unseen + cards + odd, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert got[300] == "card:12:28" and got[301] == "" and got[101] == ""


def test_patterns_reach_other_formats(spark):
    known = [(k, f"please call +49 30 55{k:05d} today") for k in range(20)] + [(50 + k, f"the server 10.0.0.{k} replied") for k in range(20)]
    known += [(80 + k, f"mail to someone{k}@example.org about it") for k in range(20)]
    values = {100: "030/5512345", 101: "030 551 2345", 102: "(030) 551-2345", 103: "555.123.4567"}
    unseen = [(i, f"please call {v} today") for i, v in values.items()] + [(104, "mail to jürgen@exämple.de about it")]
    rejected = [(200, "the server 300.1.1.1 replied"), (201, "please call +1 234 today"), (202, "in room 030 551 2346 we met"), (203, "please call 1 2 today")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(known + unseen + rejected, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in values} == {i: f"phone:12:{12 + len(v)}" for i, v in values.items()}
    assert "email:8:25" in got[104].split(",") and all(got[i] == "" for i, _ in rejected)


def conversation_brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for *_, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    marks = ["<|end|>\n", "<|assistant|>\nx<|end|>\n", "<\\|", "<\\\\|a|>", "<", "<\\", "|>", "", None, "é😀 " * 50, "word " * 3000]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(marks)]
    rows += [(2, 0, "system", "be kind"), *[(2, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " * (k % 40)) for k in range(1, 300)]]
    rows += [(3, 5, "a|>b<|c", "x"), (3, 5, "a|>b<|c", "x"), (3, None, None, None), (None, 1, "assistant", "no id"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, window string, seq int")
    formatted = chat.windows(df, budget=200, history=60)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert got == conversation_brute(rows)
    texts = [r for r in formatted.filter("conv_id = 2").orderBy("window").collect()]
    assert len(texts) > 3 and all(r["text"].startswith("<|system|>\nbe kind<|end|>\n") for r in texts)
    assert texts[1]["first_own"] > 1  # history is repeated
    assert chat.windows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.windows(df, budget=10, history=20)


def test_chat_windows_keep_the_budget(spark):
    size = lambda text: sum(1 + len(re.findall(chat.TOKEN, chat.unescape(m[2]))) for m in chat._TURN.finditer(text))
    lengths = [(7 * k) % 65 for k in range(120)]
    rows = [(1, 0, "system", "s " * 30), *[(1, k + 1, "user" if k % 2 else "assistant", f"a{k} " * n) for k, n in enumerate(lengths)]]
    rows += [(2, 0, "system", "s " * 90), *[(2, k, "assistant", f"b{k} " * 40) for k in range(1, 20)]]
    rows += [(3, k, "assistant", "漢字" * 20 + "x" * 240) for k in range(20)]
    rows += [(4, 0, "user", "u"), (4, 1, "assistant", "w " * 300), (4, 2, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(df, budget=100, history=25).cache()
    found = formatted.collect()
    assert all(r["tokens"] == size(r["text"]) and r["over"] == (r["tokens"] > 100) for r in found)
    assert [(r["conv_id"], r["first_own"], r["tokens"]) for r in found if r["over"]] == [(4, 0, 301)]
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()} == conversation_brute(rows)
    assert all(r["text"].startswith("<|system|>") for r in found if r["conv_id"] == 1)


def test_language(spark):
    docs = table(spark, SF, "documents")
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    got = language.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "the and"), (5, "z" * 200_000), (6, "\U00020000")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.predict_languages(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0 and rows[None]["held_out"] is False
    assert rows[5]["lang_pred"] != "und" and rows[6]["lang_pred"] != "und"
    assert sorted(r["doc_id"] or 0 for r in language.keep_known(odd, model).collect()) == [0, 5, 6]
    for r in language.predict_languages(odd, model).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict_languages(odd, nothing).collect()} == {"und"}
    one = language.fit(docs.filter("lang = 'de'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict_languages(odd, one).collect()} == {"und", "de"}


def test_families_are_found():
    means = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0.9], [0, 0, 0.8, 1]])
    assert language.families_of(["de", "en", "es", "fr"], means) == [["de", "en"], ["es", "fr"]]


def test_leaks(spark):
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(5000)]
    filler = lambda n: " ".join(rng.choice(words, n))
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.split()
    for k in range(4, 30, 6):
        edited[k] = "zzz"
    dropped = [w for k, w in enumerate(item.split()) if k % 8]
    rows = [
        (1, f"{filler(50)} {item} {filler(50)}"), (2, f"{filler(500)} {' '.join(edited)}"), (3, " ".join(dropped).upper() + "."), (4, filler(400)), (5, None), (6, ""), (7, "q1 q2 q3 and no more"),
        (8, f"{filler(20_000)} {item}"), (1, f"{filler(50)} {item} {filler(50)}"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "", 1), (None, "t1 t2 t3", 1), (12, item, 1)], "item_id long, text string, doc_id int")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in leaks.leaks(df, bench).collect())
    assert got == {(i, b): 2 if i == 1 else 1 for i in (1, 2, 3, 8) for b in (9, 12)}
    assert sorted(r["doc_id"] for r in leaks.without_leaks(df, bench).collect()) == [4, 5, 6, 7]
    assert leaks.leaks(df, bench.limit(0)).count() == 0 and leaks.leaks(df.limit(0), bench).count() == 0


def test_leaks_of_many_texts(spark):
    item = [f"q{i}" for i in range(100)]
    edited = [w if k % 4 else f"zz{k}" for k, w in enumerate(item)]
    fragment, rare = item[40:65], item[:30]
    rows = [(k, f"before {k} " + " ".join(edited) + f" after {k}") for k in range(1000)]
    rows += [(1000 + k, " ".join(f"f{k}x{j}" for j in range(30)) + " " + " ".join(fragment)) for k in range(1000)]
    rows += [(2000, " ".join(rare)), (2001, "q1 q2 q3 x q5 q6 q7 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in leaks.leaks(df, bench).collect()) == list(range(2001))
    assert [r["doc_id"] for r in leaks.without_leaks(df, bench).collect()] == [2001]


def test_score_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 12, 12), rng.integers(0, 12, 40)
        assert leaks.most(np.unique(a), b) >= leaks.align(a, b)[0]


def test_alignment_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        h = np.zeros((13, 21), dtype=int)
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH), h[i - 1, j] + leaks.GAP, h[i, j - 1] + leaks.GAP)
        assert leaks.align(a, b)[0] == h.max()


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="home sidebar-left"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>A</a><li>B</ul></nav><div class="cookie-notice">We use</div><article><header><h2>Head &amp; x</h2></header><p>One<br>two <b>three</b> &lt;tag&gt;
<p>Next&nbsp;para<ul><li>i1<li>i2</ul><aside>related</aside><div class="ad">buy</div><form><label>Name</label><input></form><script>var x="</p><p>no";</script>
<section id="comments"><p>Nice!</p></section></article><footer>&copy; me</footer>"""
    plain = '<div id=content><p>Long text here</p><p>More &#233; text</p></div><div class=menu><a href=/>Home</a></div><ul><li><a href=1>x</a></li></ul>'
    rows = [(1, "http://a.example/x?y", page), (2, "https://b.example/1", plain), (3, "https://b.example/2", "<div id=content><p>Just one</p><h2>t</h2>"), (4, None, None), (5, "b.example", ""), (5, "b.example", ""), (6, "http://c.example", "<article>" + "<p>x y</p>" * 5000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, host string, main int")
    got = {r["page_id"]: r for r in pages.main_texts(df).collect()}
    assert got[1]["text"] == "Head & x\n\nOne two three <tag>\n\nNext para\n\ni1\n\ni2"
    assert got[2]["text"] == "Long text here\n\nMore é text" and got[3]["text"] == "Just one\n\nt"
    assert got[4]["text"] == got[5]["text"] == "" and got[6]["text"] == "\n\n".join(["x y"] * 5000)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and pages.main_texts(df).count() == 7
    assert pages.main_texts(df.limit(0)).count() == 0


def test_pages_of_many_layouts(spark):
    body = "".join(f"<p>Sentence {k} of the long text.</p>" for k in range(5))
    text = "\n\n".join(f"Sentence {k} of the long text." for k in range(5))
    pages_of = {
        1: "<div><article><a href=1>Teaser one</a></article><article><a href=2>Teaser two</a></article></div>",
        2: f"<main>{body}</main><div class=sidebar><p>side</p></div>",
        3: f"<div id=story>{body}</div><article><p>teaser</p></article><div class=ad>buy</div>",
        4: f"<div class='content has-sidebar'><div>{body}</div><div class=sidebar>side</div></div>",
        5: f"<form action=x><div class=no-sidebar><article>{body}</article></div></form>",
        6: f"<div class=nav-open><div class=page-header-fixed>{body}<div class=comments>Nice</div></div></div>",
        7: f"<div class=sidebar>{body}</div>",
        8: f"<form>{body}</form><nav><p>n</p></nav>",
        9: f"<div class='content'>{body}</div><div id=comments><article class=comment><p>{'c ' * 20}</p></article></div>",
    }
    rows = [(i + 100 * k, url, p) for i, p in pages_of.items() for k, url in enumerate(["http://a.example/", None])]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: text for i in pages_of if i not in (1, 3)}
    assert {i: t for i, t in got.items() if i % 100 not in (1, 3)} == {i + k: t for i, t in want.items() for k in (0, 100)}
    assert all(got[i].startswith(text) and "buy" not in got[i] for i in (3, 103))


def test_pages_of_a_host_in_rounds(spark, monkeypatch):
    tags = ["p", "h2", "blockquote", "pre", "h3"]
    rows = [(i, "http://a.example/", "<article>" + "".join(f"<{t}>{t} {i}</{t}>" for k, t in enumerate(tags) if i >> k & 1) + "</article><nav>n</nav>") for i in range(32)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n\n".join(f"{t} {i}" for k, t in enumerate(tags) if i >> k & 1) for i in range(32)}
    for most in (64, 2):
        monkeypatch.setattr(pages, "FOLD_ROWS", most)
        assert {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()} == want


def test_wrapper_groups():
    a = pages.folded(["h", "p", "p#", "p", "p#", "f"])
    assert a == ["h", ["+", ["p", "p#"]], "f"]
    b = pages.aligned(a, ["h", "x", "f"])
    assert b == ["h", ["?", [["+", ["p", "p#"]]]], ["?", ["x"]], "f"] and pages.aligned(b, a) == b


def test_sharding(spark):
    rows = TEXTS[:-2] + [(100 + k, "same text" if k % 3 == 0 else f"text {k} " * (k % 50)) for k in range(6000)]
    out = sharding.sharded(frame(spark, rows)).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"}
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]] and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    mean, largest = sum(load.values()) / 8, max(r["size"] for r in out)
    assert set(load) == set(range(8)) and max(load.values()) <= (1 + sharding.SLACK) * mean + largest + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(h) > 1 for h in homes.values()) <= 60  # only at cuts
    again = sharding.sharded(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.sharded(frame(spark).limit(0)).count() == 0


def test_ring_moves_little():
    rng = np.random.default_rng(0)
    old, new = sharding.ring(8), sharding.ring(9)
    find = lambda nodes, p: nodes[np.searchsorted([x for x, _ in nodes], p) % len(nodes)][1]
    places = rng.integers(0, sharding.RING, 2000)
    moved = [(find(old, p), find(new, p)) for p in places]
    assert all(b in (a, 8) for a, b in moved) and sum(a != b for a, b in moved) < 500


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_forms(spark, name):
    con = duckdb.connect()
    for of in ("documents", "embeddings", "labels"):
        con.execute(f"create view {of} as select * from '{SF}/{of}.parquet'")
    rows = QUERIES[name](spark, SF)
    found = con.sql(f"select {', '.join(rows.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(found, key=str)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").unionByName(spark.createDataFrame([(10**6, "123", None, None, 3), (10**6 + 1, None, None, "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert kept.columns == docs.columns and set(rows) - {r["doc_id"] for r in kept.collect()} == {10**6, 10**6 + 1}
    unique = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    expected = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, _, c in expected})
    clean = corpus_pipeline.decontaminate(spark, unique, SF).cache()
    items = [WORD.findall(lower(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    exact = {r["doc_id"] for r in unique.collect() if any(f" {' '.join(i)} " in f" {' '.join(WORD.findall(lower(r['text'])))} " for i in items)}
    gone = {r["doc_id"] for r in unique.collect()} - {r["doc_id"] for r in clean.collect()}
    assert exact <= gone and len(gone) <= len(exact) + 2
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    total = sum(len(WORD.findall(r["text"])) for r in clean.collect())
    assert mixed.columns == docs.columns and abs(sum(len(WORD.findall(r["text"])) for r in mixed.collect()) / total - 1.5) < 0.15
    digests = corpus_pipeline.token_files(spark, mixed, SF)
    assert digests.count() == mixed.count()
