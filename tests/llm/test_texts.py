"""Training-data operators on small tables: brute force, exact round trips, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from quillstone.llm import copies, leaks, near, packing, private, sentences
from quillstone.llm.words import canonical, fields, words
from quillstone.plans.scratch import Scratch

ODD = [("n1", None, "x"), (None, "text", "x"), ("e1", "", "x"), ("e2", " \n", "x")]
SCHEMA = "id string, content string, key string"


def rows(spark, found):
    return spark.createDataFrame([(i, t, "clash") for i, t in found] + ODD, SCHEMA)


def test_fields_in_any_order_and_format():
    a = "vendor: Groshe Two | owner_team=x y | record: K1"
    assert fields(a) == [("vendor", "Groshe Two "), ("owner_team", "x y "), ("record", "K1")]
    same = ['{"record": "k1", "owner team": "X  Y", "VENDOR": "groshe two"}', "record: K1\nvendor: groshe\n two\nowner_team: x, y", "- owner_team: x y; record: K1; vendor: Groshe two"]
    assert len({canonical(t) for t in [a, *same]}) == 1
    assert canonical("A b: c.") == canonical("a  B C") != canonical("b a c")
    labels = ["owner-team", "E-mail", "cost/unit", "2nd owner", "a label of considerably more than forty-one characters", "size (mm)"]
    assert canonical("\n".join(f"{x}: v {i}" for i, x in enumerate(labels))) == canonical("; ".join(f"{x.upper()} = V {i}" for i, x in reversed([*enumerate(labels)])))
    assert canonical('{"Owner": "Bob B."}') == canonical("owner: bob b") == canonical("owner bob b")
    assert fields("When it stops, call; then wait") is None and fields('{"broken": ') is None


def test_copies_hot_group_and_small_buckets(spark):
    rng = random.Random(2)
    found = [(f"b{i:03}", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([2, 3])))) for i in range(300)] + [(f"h{i:03}", "the HOT\t text!") for i in range(200)] + [("b001", "alpha beta")]
    df = rows(spark, found)
    groups, pairs = copies.copies(copies.record_keys(df, scratch := Scratch(spark, "t")), scratch, bucket_rows=3)
    best = {}
    for i, t in [*found, ("e1", ""), ("e2", "")]:
        best[i] = min(best.get(i, "x"), hashlib.sha256(canonical(t).encode()).hexdigest())
    by = {}
    for i, k in best.items():
        by.setdefault(k, []).append(i)
    assert {tuple(r) for r in pairs.collect()} == {(min(v), x) for v in by.values() for x in v if x != min(v)}
    assert {r.keep: r.n for r in groups.collect()} == {min(v): len(v) for v in by.values() if len(v) > 1}
    assert copies.copies(copies.record_keys(df.limit(0), scratch), scratch)[1].count() == 0


def test_trie_counts():
    t = copies.Trie()
    for k in (b"aaaa", b"aaab", b"aaaa", b"bbbb"):
        t.add(k, "z", 1)
    t.add(b"aaab", "a", 3)
    t.add(b"aa", "m", 2)
    assert {k: (s, n) for k, s, n in t.terminals()} == {b"aaaa": ("z", 2), b"aaab": ("a", 4), b"bbbb": ("z", 1), b"aa": ("m", 2)}


@pytest.mark.parametrize("extend, tail", [(2, 64), (2, 5), (40, 9)])
def test_long_lists_lose_no_pair_when_split(spark, monkeypatch, extend, tail):
    monkeypatch.setattr(near, "EXTEND", extend)
    monkeypatch.setattr(near, "TAIL", tail)
    rng, found = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(50)]
    for g in range(60):
        base = rng.sample(vocabulary, rng.choice([2, 3, 4, 12, 30, 45]))
        for v in range(4):
            found.append((f"r{g:02}{v}", " ".join({w for w in base if rng.random() > 0.08} | {*rng.sample(vocabulary, rng.choice([0, 0, 1, 2]))}) or "w0"))
    got = {tuple(r) for r in near.member_pairs(*near.near_duplicates(rows(spark, found), Scratch(spark, "t"))).collect()}
    sets = {i: (set(words(t)), canonical(t)) for i, t in found}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and 10 * len(sets[a][0] & sets[b][0]) >= 7 * len(sets[a][0] | sets[b][0])}
    assert got == want and len(want) > 100


def test_a_long_list_forms_few_pairs(monkeypatch):
    """5000 sets of 40 words with one word in common: 12.5 million pairs; split by their next words, hardly any."""
    rng = np.random.default_rng(3)
    rows, prefix = 5000, 13
    formed, windows = [0], near._windows

    def counted(*args):
        for i, j in windows(*args):
            formed[0] += len(i)
            yield i, j

    monkeypatch.setattr(near, "_windows", counted)
    tails = np.sort(rng.integers(0, 5000, (rows, prefix + 1)), axis=1).astype(np.uint16)
    tails[1] = tails[0]
    parity = [rng.integers(0, 2**63, rows).astype(np.uint64) for _ in range(4)]
    for p in parity:
        p[1] = p[0]
    same = np.zeros(rows, np.int64)
    out = near._compare(same, same - 1, np.arange(rows), same + 40, same, parity, tails.ravel(), np.arange(rows + 1) * (prefix + 1), 1024)
    assert out.tolist() == [[0, 1]] and formed[0] < 1_000_000


@pytest.mark.parametrize("long", [16_384, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(near, "LIST_ROWS", long)
    rng, found = random.Random(4), []
    vocabulary = [f"w{i}" for i in range(60)]
    for g in range(25):
        base = rng.sample(vocabulary, rng.choice([1, 4, 12, 30]))
        for v in range(5):
            some = [w for w in base if rng.random() > 0.08] + rng.sample(vocabulary, rng.choice([0, 0, 1, 2]))
            rng.shuffle(some)
            found.append((f"r{g:02}{v}", " ".join(some) or "w0"))
    df = rows(spark, [*found, ("r000", found[0][1])])
    got = {tuple(r) for r in near.member_pairs(*near.near_duplicates(df, Scratch(spark, "t"))).collect()}
    sets = {i: (set(words(t)), canonical(t)) for i, t in found}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and 10 * len(sets[a][0] & sets[b][0]) >= 7 * len(sets[a][0] | sets[b][0])}
    assert got == want and len(want) > 50
    assert near.near_duplicates(df.limit(0), Scratch(spark, "t"))[1].count() == 0


def test_units_of_long_quotations_addresses_and_other_scripts(spark):
    long = "He said “" + " ".join(f"This is part {i}." for i in range(400)) + "” and left. Then it ended."
    texts = [long, "See https://a.example/x.y?z=1 or a.b@c.example.org and go. Then stop.", "یہ ایک ہے۔ یہ دو ہے۔", "See Gen. Smith and Rev. Jones now. Ok.", "（" + "これは文です。" * 9 + "）です。次です。"]
    found = sentences.sentence_units(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).collect()
    by = {i: [r.text for r in sorted(found, key=lambda r: r.start_at) if r.doc_id == i] for i in range(len(texts))}
    assert [len(v) for v in by.values()] == [2, 2, 2, 2, 2]
    assert all(texts[r.doc_id][r.start_at :].startswith(r.text) for r in found) and by[0][0] == long[: -len(" Then it ended.")]


def test_every_capacity_is_packed(spark):
    counts = spark.createDataFrame([(i, i + 1) for i in range(6)], "id int, tokens bigint")
    budgets = spark.createDataFrame([(i, 10 + i) for i in range(1200)], "budget_id int, capacity_tokens int")
    assert packing.pack(counts, budgets, Scratch(spark, "t")).select("budget_id").distinct().count() == 1200


def test_little_space_is_left_unused(spark):
    rng = random.Random(8)
    sizes = [min(2000, int(rng.lognormvariate(5, 1)) + 1) for _ in range(5000)]
    counts = spark.createDataFrame([*enumerate(sizes)], "id int, tokens bigint")
    boxes = packing.pack(counts, spark.createDataFrame([(1, 512), (2, 2048)], "budget_id int, capacity_tokens int"), Scratch(spark, "t"), shard_items=1000)
    for budget, capacity in ((1, 512), (2, 2048)):
        own = boxes.where(f"budget_id = {budget}").toPandas()
        assert own["tokens"].sum() == sum(sizes) and own.groupby("container")["tokens"].sum().max() <= capacity
        assert 1 - sum(sizes) / (own["container"].nunique() * capacity) < 0.03


def test_formed_entities():
    t = "Mail a.b+c@x-y.example or ann (at) site [dot] org, call +44 (0)20 7946 0058, 07700 900 902 or (212) 555-0160. QQ 12 34 56 C; SSN 000 11 2222; 12 Elm Street, Bigtown. P.O. Box 12, Ayton."
    kinds = [k for _, _, k in sorted(private._formed(t))]
    assert kinds == ["email", "email", "phone", "phone", "phone", "id_number", "id_number", "address", "address"]
    for plainly in ("Build 10.4.26.51 of x", "Score was 92-53-925", "order 20490898949", "Bought 74 @ 4.74 each", "@handle said", "part no. 8460-6084-X", "Slot is 2024-02-12 02:38:00", "The Old Elm Street Market", "IPv4 203.0.113.43", "Invoice 946/41/4641", "bay 525"):
        assert private._formed(plainly) == []


def test_formed_entities_of_other_countries():
    kinds = {"Passport AB1234567": "id_number", "passport no. C01X00T47": "id_number", "AB 12 34 56 C": "id_number", "Aadhaar 2345 6789 0123": "id_number", "GB82 WEST 1234 5698 7654 32": "id_number", "12 Elm Crescent, Bath": "address", "Via Roma 12, Milano": "address", "020 7946 0958": "phone", "tel 03-1234-5678": "phone"}
    assert {t: private._formed(f"See {t} there.")[0][2] for t in kinds} == kinds
    for plainly in ("GB83 WEST 1234 5698 7654 32", "via port 8080, then", "tel 2024-01-02", "phone 4 times", "passport renewal", "close 12 tickets"):
        assert private._formed(plainly) == []


def test_names_and_redaction():
    names = private.Names({"greta", "олена"}, {"quist", "stad"} | {"uist"})
    found = lambda t: [t[a:z] for a, z, k in private.find(t, names) if k == "name"]
    assert found("Ask Greta Heaquist why. Dear Fluquist, Greta, hello. Mrs Greta L. de la Moxstad-Tiquist left.") == ["Greta Heaquist", "Fluquist, Greta", "Mrs Greta L. de la Moxstad-Tiquist"]
    assert found("Met Dr. Bronquist and J. Torstad. Dr Bronquist tablets; Greta river; greta.heaquist@x.example") == ["Dr. Bronquist", "J. Torstad"]
    assert found('{"a": "\\u041e\\u043b\\u0435\\u043d\\u0430 \\u041b\\u043e\\u0441"}') == ['\\u041e\\u043b\\u0435\\u043d\\u0430 \\u041b\\u043e\\u0441']
    text = "Ask GRETA HEAQUIST now: x@y.example."
    assert private.redact(text, private.find(text, names)) == "Ask [NAME] now: [EMAIL]."


def test_rare_names_are_learned_at_any_size_and_by_join(spark, monkeypatch):
    found = [(f"s{i}", f"We thank Mrs {stem}stad for it.") for i, stem in enumerate(["Alt", "Ber", "Cor", "Dun", "Elm", "Far"])]
    found += [(f"g{i}", f"Mail zorah.box{i}@mail.example about it.") for i in range(3)] + [("both", "Then Zorah Norstad left, and ZORAH ALTSTAD too."), ("again", "Then Zorah Norstad left, and ZORAH ALTSTAD too.")]
    filler = spark.range(40_000).selectExpr("concat('f', id) as id", "'the river is calm' as content", "'x' as extra")
    table = spark.createDataFrame(found, "id string, content string").selectExpr("id", "content", "'x' as extra").unionByName(filler)
    run = lambda: {r.id: (r.clean, r.kinds) for r in private.sanitise(table, Scratch(spark, "t")).where("id not like 'f%'").collect()}
    few = run()
    assert few["both"] == few["again"] == ("Then [NAME] left, and [NAME] too.", ["name"])
    monkeypatch.setattr(private, "BROADCAST_TERMS", 0)
    assert run() == few


def test_names_are_learned_from_the_corpus(spark):
    rng, found = random.Random(1), []
    given, tails = ["miriam", "kenji", "olga", "bruno"], ["worth", "escu"]
    for i in range(160):
        g, s = rng.choice(given), f"k{chr(97 + i % 20)}{chr(97 + i % 7)}l{rng.choice(tails)}"
        text = [f"Send it to {g}.{s}@mail.example please.", f"Ask {g.title()} {s.title()} why it failed.", f"The river sensor reads {i} on the metric scale."][i % 3]
        found.append((f"b{i:03}", text + " The new policy replaces nothing and the harbor depends on the meadow."))
    clean = {r.id: (r.clean, r.kinds) for r in private.sanitise(rows(spark, found), Scratch(spark, "t")).collect()}
    for i, (name, _) in enumerate(found):
        assert clean[name][1] == [["email"], ["name"], []][i % 3], clean[name]
    assert clean["e1"] == ("", []) and len(clean) == 162
    assert private.sanitise(rows(spark, []).limit(0), Scratch(spark, "t")).count() == 0


def test_packing_holds_every_token_once(spark):
    rng = random.Random(9)
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([0, 0, 1, 10, 11, 25, 100] + [rng.randrange(1, 14) for _ in range(400)])], "id bigint, tokens bigint")
    budgets = spark.createDataFrame([(1, 10), (2, 64), (2, 64)], "budget_id bigint, capacity_tokens int")
    found = packing.pack(counts, budgets, Scratch(spark, "t"), shard_items=40).collect()
    want = {r.id: r.tokens for r in counts.collect()}
    for budget, capacity in ((1, 10), (2, 64)):
        pieces, boxes = {}, {}
        for r in found:
            if r.budget_id == budget:
                pieces.setdefault(r.id, []).append((r.first_token, r.tokens))
                boxes[r.container] = boxes.get(r.container, 0) + r.tokens
                assert want[r.id] > capacity or r.piece == 0
        assert max(boxes.values()) <= capacity
        for i, n in want.items():
            at = 0
            for first, tokens in sorted(pieces[i]):
                assert first == at
                at += tokens
            assert at == n
        assert len(boxes) * capacity <= 1.25 * sum(want.values())
    assert packing.pack(counts.limit(0), budgets, Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(counts, spark.createDataFrame([(1, 0)], "budget_id bigint, capacity_tokens int"), Scratch(spark, "t"))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|>")], "doc_id bigint, text string")
    found = dict(packing.token_counts(df).collect())
    assert found[1] == 2 and found[2] == 0 and found[4] > 1 and len(found) == 3


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice([*vocabulary, "Other"]) for _ in range(40)]
        for _ in range(rng.choice([0, 1, 2])):
            t = words(rng.choice(items)[1])
            a = rng.randrange(len(t))
            w[rng.randrange(len(w)) : 0] = [x.upper() + "," for x in t[a : a + rng.randrange(8, 20)]]
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame([*docs, (100, None), (None, "x"), (101, ""), docs[0]], "doc_id bigint, text string")
    it = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    want = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            t = words(item)
            best = 0
            for a in range(len(w)):
                for b in range(len(t)):
                    n = 0
                    while a + n < len(w) and b + n < len(t) and w[a + n] == t[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= 12:
                want[d, i] = best
    for shard, block in ((1_000_000, 8_000_000), (50, 300)):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        found = leaks.find_leaks(df.coalesce(1), it)
        assert {(r.doc_id, r.item_id): r.words for r in found.collect()} == want and want
    assert leaks.without_leaks(df, found).where("doc_id < 100").count() == 60 - len({d for d, _ in want}) + (0 if 0 in {d for d, _ in want} else 1)
    assert leaks.find_leaks(df, it.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), it).count() == 0


CASES = [
    ("Dr. Ann saw Fig. 3 at 3.5 mm. It stopped! Really?", ["Dr. Ann saw Fig. 3 at 3.5 mm.", "It stopped!", "Really?"]),
    ("TITLE\n \nOne line\nbroken. two starts small.Three has no space.", ["TITLE", "One line\nbroken.", "two starts small.", "Three has no space."]),
    ('He reads "Hot. Wait 3 s." on it. “Whole quote.” Next (in brackets.) End...', ['He reads "Hot. Wait 3 s." on it.', "“Whole quote.”", "Next (in brackets.)", "End..."]),
    ("1. A lever:\na) one;\nb) two.\n\n[0002] Run 30 to 60 min.. Go, etc. Then z. B. Typ 4, d. h. leer.", ["1. A lever:\na) one;\nb) two.", "[0002] Run 30 to 60 min..", "Go, etc.", "Then z. B. Typ 4, d. h. leer."]),
    ("阀门上标有“请勿打开！”字样。第二句？“引文。”", ["阀门上标有“请勿打开！”字样。", "第二句？", "“引文。”"]),
    ("弁には「高温。待て。」とある。（表1を参照。）に示す。", ["弁には「高温。待て。」とある。", "（表1を参照。）に示す。"]),
    ("वाल्व रुकता है। डॉ. राम आए।", ["वाल्व रुकता है।", "डॉ. राम आए।"]),
    ("วาล์วปิด เปิดที่ 7.5 มม. ที่ตัว", ["วาล์วปิด", "เปิดที่ 7.5 มม. ที่ตัว"]),
    ("밸브 를 지지한다. 예컨대 No. 76 에서 안내한다.", ["밸브 를 지지한다.", "예컨대 No. 76 에서 안내한다."]),
    ("Вал, т. е. новый, рис. 5, цел. Он держит «Горячо. Ждать.» рядом. Клапан и т. д. На нём.", ["Вал, т. е. новый, рис. 5, цел.", "Он держит «Горячо. Ждать.» рядом.", "Клапан и т. д.", "На нём."]),
    ("Auf dem Rotor steht »Ist es zu? Ja.« für ihn. »Ganz zitiert.« Ende: no. Wirklich.", ["Auf dem Rotor steht »Ist es zu? Ja.« für ihn.", "»Ganz zitiert.«", "Ende: no.", "Wirklich."]),
    ("  \n\n ", []), ("", []), (None, []), ("𝔸 bb. C　", ["𝔸 bb.", "C"]),
]


def test_sentence_units(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(None, "A. B.", "x")], "doc_id int, text string, unit string")
    found = {}
    for r in sentences.sentence_units(df).orderBy("unit").collect():
        found.setdefault(r.doc_id, []).append(r.text)
        assert CASES[r.doc_id][0][r.start_at :].startswith(r.text)
    assert found == {i: u for i, (_, u) in enumerate(CASES) if u}
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "One two three. " * 5000
    found = sentences.sentence_units(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("start_at").orderBy("start_at").collect()
    assert [r[0] for r in found] == list(range(0, len(text), 15))


def test_registered_queries_have_their_columns(spark, small):
    want = {"p2_found": ["keep_id", "copy_id"], "p3_found": ["block_a", "block_b"], "p5_found": ["block_id", "kind"], "p6_found": ["block_a", "block_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_at"]}
    for name, columns in want.items():
        df = entry.queries()[name](spark, small)
        assert df.columns == columns and df.count() == df.distinct().count() > 0, name
