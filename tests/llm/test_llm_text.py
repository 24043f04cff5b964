import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from voxelloom.llm import chat, decontaminate, secret_scan, surrogates

DOCS = "/root/testdata/sf0.001/documents.parquet"


# --- chat ---------------------------------------------------------------------------------------

RECORDS = {
    "prompt": {"prompt": "hi", "completion": "yo"},
    "prompt_response": {"response": "yo", "prompt": "hi"},
    "instruction": {"instruction": "hi", "input": "", "output": "yo"},
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    "conversations": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
}


def test_layouts_become_the_same_turns(spark):
    records = spark.createDataFrame([(n, json.dumps(r)) for n, r in RECORDS.items()] + [
        ("unknown", '{"q": 1}'), ("broken", "{"), ("null", None), ("empty", '{"messages": []}')], "name string, record string")
    out = {r.name: r for r in chat.canonical(records).collect()}
    for name in RECORDS:
        assert out[name].layout == name and [(t.role, t.text) for t in out[name].turns] == [("user", "hi"), ("assistant", "yo")]
    assert all(out[n].layout is None and out[n].turns == [] for n in ("unknown", "broken", "null", "empty"))


def test_null_fields_are_empty_and_numbers_do_not_matter(spark):
    records = spark.createDataFrame([('{"prompt": null, "completion": 3}',)], "record string")
    row = chat.canonical(records).first()
    assert row.layout == "prompt" and [t.text for t in row.turns] == ["", "3"]


def test_render_round_trip(spark):
    rnd = random.Random(2)
    parts = ["<|im_end|>", "<|im_start|>", "&", "&amp;", "&lt;|", "<", "|", "\n", "é", "ok", "&nl;", " "]
    convs = [[(rnd.choice(["user", "assistant", "a\nb&<|", ""]), "".join(rnd.choices(parts, k=rnd.randint(0, 9)))) for _ in range(rnd.randint(0, 5))] for _ in range(60)]
    df = spark.createDataFrame([(i, [(n, *t) for n, t in enumerate(c)]) for i, c in enumerate(convs)], f"id long, turns {chat.TURN}")
    made = df.withColumn("r", chat.render(F.col("turns")))
    out = made.select("id", "r.formatted", chat.read_back(F.col("r.formatted")).alias("back"), chat.masked(F.col("r.formatted"), F.col("r.loss")).alias("learn")).collect()
    for r in out:
        assert [tuple(t) for t in r.back] == convs[r.id]
        assert r.learn == "".join(t for role, t in convs[r.id] if role == "assistant")


@pytest.mark.parametrize("block, page", [(256, 4096), (2, 3)])
def test_long_conversations_take_no_square_of_their_turns(spark, monkeypatch, block, page):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "PAGE", page)
    n = 40_000 if block > 2 else 41
    text = F.concat(F.lit("é\U0001f600<|&\n"), F.repeat(F.lit("z"), (F.col("id") % 60).cast("int")))
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    one = spark.range(n).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("at"), role.alias("role"), text.alias("text")))).alias("turns"))
    begun = time.monotonic()
    r = one.withColumn("r", chat.render(F.col("turns"))).select(
        "r.formatted", "r.loss", chat.read_back(F.col("r.formatted")).alias("back"), chat.masked(F.col("r.formatted"), F.col("r.loss")).alias("learn")).first()
    assert time.monotonic() - begun < 40
    want = ["é\U0001f600<|&\n" + "z" * (i % 60) for i in range(n)]
    assert [t.text for t in r.back] == want and r.learn == "".join(want[1::2])
    at = [s.start for s in r.loss]
    assert [r.formatted[a - len("assistant\n"):a] for a in (at[0], at[-1])] == ["assistant\n"] * 2 and len(at) == n // 2


def test_gather_orders_turns_and_keeps_null_keys(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (5, 0, "user", None), (5, 0, None, "z"), (5, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.gather(chat.canonical(records), "conv_id").collect()}
    assert out == {None: [("user", "a"), ("assistant", "b")], 5: [("user", "first"), ("", "z"), ("user", "")]}


# --- decontamination ----------------------------------------------------------------------------

def brute_matches(docs, items, size=5, t=0.8):
    out = set()
    for i, item in items:
        mine = set(decontaminate.shingles(decontaminate.words_of(item or ""), size))
        for d, text in docs:
            w = decontaminate.words_of(text or "")
            width = len(next(iter(mine))) if mine else 0
            theirs = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if mine else set()
            if mine and len(mine & theirs) >= t * len(mine) - 1e-9:
                out.add((d, i, len(mine & theirs), len(mine)))
    return out


def test_containment_matches_brute_force(spark, odd, none, monkeypatch):
    rnd = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 4, 5, 6, 20, 45])))) for i in range(40)] + [(40, None), (3, "twice the same id")]
    docs = []
    for d in range(80):
        w = rnd.choices(words, k=rnd.randint(0, 200))
        if rnd.random() < 0.8:
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randint(0, 3)):
                if part:
                    part[rnd.randrange(len(part))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() + rnd.choice([",", "!", ""]) for x in part]
        docs.append((d, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_matches(docs, items)
    assert len(want) > 30
    for limit in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (limit,))
        assert {tuple(r) for r in decontaminate.matches(df, bench).collect()} == want
        assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {m[0] for m in want}
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.matches(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


# --- secrets ------------------------------------------------------------------------------------

def brute_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_match_plain_patterns(spark, odd):
    rnd = random.Random(6)
    bits = ["token", "TOKEN=", "=", ": ", '"', "secret", "api_key", "ſecret=", "abcdefgh", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "f", " ", "é", "password='x", "short"]
    extra = ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string").unionByName(odd.select("doc_id", "text")).unionByName(
        spark.read.parquet(DOCS).selectExpr("doc_id + 100000 AS doc_id", "text"))
    found = secret_scan.scan(docs)
    assert found.count() == docs.count()
    got = sorted((r.doc_id, [tuple(s) for s in r.spans if s.kind != "random"]) for r in found.where("doc_id is not null").collect())
    assert got == sorted((r.doc_id, brute_spans(r.text or "")) for r in docs.where("doc_id is not null").collect())


def test_random_strings_are_told_from_words(spark):
    rnd = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choices(alphabet, k=32)) for _ in range(40)]
    names = ["get_user_account_by_name", "InternationalizationHelper", "thonstandation_reading_list", "configuration-manager-service"]
    docs = [(i, f"see {rnd.choice(names)} and {k} for {rnd.choice(names)}") for i, k in enumerate(keys)]
    real = spark.read.parquet(DOCS).selectExpr("doc_id + 1000 AS doc_id", "text")
    out = secret_scan.scan(spark.createDataFrame(docs, "doc_id long, text string").unionByName(real)).collect()
    hits = [(dict(docs)[r.doc_id][s.start : s.end]) for r in out if r.doc_id < 1000 for s in r.spans if s.kind == "random"]
    assert len(set(hits) & set(keys)) >= 38 and not set(hits) & set(names)
    assert sum(s.kind == "random" for r in out if r.doc_id >= 1000 for s in r.spans) <= 2


def test_secret_scan_of_nothing(none):
    assert secret_scan.scan(none).count() == 0


# --- surrogates ---------------------------------------------------------------------------------

KEY = b"k"


def test_formats_are_kept():
    text = "Mr. John Smith (john.smith@Mail.example.com, +1 (319) 555-5132, 4799134681044206, 10.20.30.200, 123-45-6789, GB82 WEST 1234 5698 7654 32)"
    out, kinds = surrogates.rewrite(text, KEY, {})
    assert kinds == ["given", "surname", "email", "phone", "card", "ip", "ssn", "iban"]
    shape = re.compile(r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+ \([a-z]+\.[a-z]+@[A-Z][a-z]+\.[a-z]+\.com, \+1 \(\d{3}\) \d{3}-\d{4}, 4\d{15}, \d\d\.\d\d\.\d\d\.\d{3}, \d{3}-\d\d-\d{4}, GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d\)$")
    assert shape.match(out), out
    card, iban = re.search(r"4\d{15}", out)[0], re.search(r"GB[^)]*", out)[0].replace(" ", "")
    assert surrogates.luhn("4799134681044206") == surrogates.luhn(card) and surrogates.mod97(iban) == 1
    given = out.split()[1]
    assert surrogates.GENDER[given] == "m" and surrogates.rewrite(text, KEY, {}) == (out, kinds) != surrogates.rewrite(text, b"other", {})


def test_script_and_gender():
    out, _ = surrogates.rewrite("Доктор Елена Орлова, Anna Keller, Νίκος Παππάς", KEY, {})
    a, b, c = (x.split()[-2:] for x in out.split(","))
    assert surrogates.GENDER[a[0]] == "f" and surrogates.script_of(a[0]) == "cyrillic" and a[1].endswith("а")
    assert surrogates.GENDER[b[0]] == "f" and surrogates.script_of(b[0]) == "latin"
    assert surrogates.GENDER[c[0]] == "m" and surrogates.script_of(c[0]) == "greek"


def test_clean_text_and_numbers_stay():
    for t in ("Version 2.0 of 12.5 items (1234).", "", "AKIA 0641917ea4e9feb9cda83477b57ac2654884f485", "3.14159265358979 300.1.2.3"):
        assert surrogates.rewrite(t, KEY, {})[0] == t


def test_numbers_beside_other_tokens_are_found():
    """Only what touches a number can make it part of a word."""
    for text, kind in (("Room B12, 555-123-4567 please", "phone"), ("v2 192.168.10.44 up", "ip"), ("SSN 123-45-6789 2nd copy", "ssn"), ("call 555-867-5309, 3rd floor", "phone"),
                       ("B12: 4799134681044206, 5th", "card"), ("x1 +49 30 1234 5678 2a", "phone"), ("Tel(555) 123-4567", "phone")):
        out, kinds = surrogates.rewrite(text, KEY, {})
        assert kinds == [kind] and out != text and len(out) == len(text)
        assert re.sub(r"\d", "0", out) == re.sub(r"\d", "0", text)
    for text in ("id_123-45-6789", "a192.168.10.44", "x@192.168.10.44", "123-45-6789b", "555-123-4567é", "1.192.168.10.44", "192.168.10.44.5"):
        assert surrogates.rewrite(text, KEY, {}) == (text, [])


def kinds_of(text):
    return surrogates.rewrite(text, KEY, {})[1]


def test_names_of_many_forms():
    for text, kinds in (("John F. Kennedy spoke", ["given", "surname"]), ("Dr. van Helsing came", ["surname"]), ("Mr. O'Brien left", ["surname"]), ("DAVID O'NEILL", ["given", "surname"]),
                        ("Prof Ada van der Berg", ["given", "surname"]), ("Mme Dupont-Leroy", ["surname"])):
        out, got = surrogates.rewrite(text, KEY, {})
        assert got == kinds and out != text, text
    out, kinds = surrogates.rewrite("Keller was late. Anna Keller sat down, Keller left. KELLER!", KEY, {})
    words = re.findall(r"\w+", out)
    assert kinds == ["given", "surname", "surname", "surname"] and words[0] == "Keller"  # before she is named, it may be any word
    assert words[4] == words[7] != "Keller" and words[9] == words[7].upper()


def test_numbers_need_a_reason():
    for text in ("id 1719847362123", "ISBN 9780306406157", "x=12345678901234567", "pi 3.1415926535897932", "version 1.2.3.4", "v1.2.3.4 is out", "rooms 123 45 6789"):
        assert kinds_of(text) == [], text
    assert kinds_of("SSN 123 45 6789") == ["ssn"] and kinds_of("host 1.2.3.4 up") == ["ip"] and kinds_of("card 4222222222222 ok") == ["card"]
    for text in ("at 2001:db8:85a3:0:0:8a2e:370:7334 now", "at fe80::1ff:fe23:4567:890a now"):
        out, kinds = surrogates.rewrite(text, KEY, {})
        assert kinds == ["ipv6"] and re.sub("[0-9a-f]", "x", out) == re.sub("[0-9a-f]", "x", text)


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    for text in ("a." * 500_000, "A" * 1_000_000 + "@", "a@" * 500_000, "1 " * 500_000, "1.2." * 250_000, "Mr. " * 250_000, "A'" * 500_000, "1:" * 500_000, "Anna " * 200_000):
        surrogates.mentions(text + " x@y ")
    assert time.time() - start < 60


def test_clashing_kinds_column(spark):
    out = surrogates.pseudonymise(spark.createDataFrame([(1, "Anna Keller", "mine")], "doc_id long, text string, pii_kinds string"), KEY)
    assert out.columns == ["doc_id", "text", "pii_kinds", "pii_kinds_"] and out.first().pii_kinds == "mine"


def test_distinct_and_coreferent_over_the_corpus(spark):
    """More surnames and short addresses than their pools hold: all differ, and
    a name gets the same surrogate in every document."""
    names = [f"Kr{chr(97 + i // 26)}{chr(97 + i % 26)}mer" for i in range(120)]
    addresses = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    docs = [(i, f"Herr {n} wrote from {addresses[i % 81]}.\nFrau {n} too") for i, n in enumerate(names)] + [(999, None), (1000, "plain")]
    out = {r.doc_id: r for r in surrogates.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), KEY, max_broadcast=0).collect()}
    seen = {}
    for i, n in enumerate(names):
        first, second = re.fullmatch(r"Herr (\S+) wrote from (?:\S+)\.\nFrau (\S+) too", out[i].text).groups()
        assert first == second and first.casefold() not in {x.casefold() for x in names}
        seen[n] = first
    assert len(set(seen.values())) == len(names)
    ips = {addresses[i % 81]: re.search(r"from (\S+)\.\n", out[i].text)[1] for i in range(len(names))}
    assert len(set(ips.values())) == len(ips) and not set(ips.values()) & set(ips)
    assert out[999].text == "" and out[1000].text == "plain" and out[1000].pii_kinds == []


def test_surrogates_odd_rows(odd, none):
    out = surrogates.pseudonymise(odd, KEY)
    assert out.columns == [*odd.columns, "pii_kinds"] and out.count() == odd.count()
    assert surrogates.pseudonymise(none, KEY).count() == 0


def test_rest_of_a_touched_run_is_a_candidate():
    text = "x1y2z3w4v5u6t7s8-" + "0123456789abcdef" * 2 + "=Qq9Ww8Ee7Rr6Tt5Yy4 k=" + "ab" * 3
    spans = secret_scan.base_spans(text)
    assert [text[a:e] for a, _, e, _ in spans] == ["0123456789abcdef" * 2]
    assert secret_scan.candidates(text, spans) == [(0, "x1y2z3w4v5u6t7s8-"), (49, "=Qq9Ww8Ee7Rr6Tt5Yy4")]
    assert secret_scan.candidates(text, []) == [(0, text.split(" ")[0])]


def test_secret_scan_is_linear():
    import time

    text = ("0" * 32 + " secret=abcdefgh " + "Q" * 20 + " ") * 20_000
    start = time.time()
    spans = secret_scan.base_spans(text)
    assert len(secret_scan.candidates(text, spans)) == 20_000 and time.time() - start < 10
