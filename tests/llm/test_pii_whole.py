"""Personal data that must not stay in clear: texts and expectations written apart from ``pii.PATTERNS``."""
import re

from pyspark.sql import functions as F

from prudent.llm import pii

KEY = "k"


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", pii.pseudonymised(F.col("text"), KEY).alias("new"), pii.found_kinds(F.col("text")).alias("kinds")).orderBy("i").collect()
    return [(r.new, r.kinds) for r in rows]


MAILS = [("_jane@example.com", "_jane"), ("list:\n-jane@example.com", "-jane"), ("mail=%20jane@example.com", "%20jane"),
         ("to " + "longname" * 12 + "@example.com.", "longname" * 12), ("+jane@example.com", "+jane"), ("x .jane@example.com", ".jane"),
         ("a" * 3000 + "@example.com", "a" * 3000), ("a@jane@example.com", "jane")]


def test_mail_names_are_taken_whole(spark):
    for (text, name), (new, kinds) in zip(MAILS, replaced(spark, [t for t, _ in MAILS])):
        assert kinds == ["email"], text
        at = text.index(name + "@example.com")
        assert new[:at] == text[:at] and len(new) == len(text)
        mask = lambda v: re.sub("[a-z]", "a", re.sub("[0-9]", "0", v))
        assert mask(new) == mask(text) and name not in new and "example.com" not in new


def test_long_strings_are_permuted_in_linear_time(spark):
    a, b = "x" * 40_000, "x" * 39_999 + "y"
    (new_a, _), (new_b, _) = replaced(spark, [f"{v}@example.com" for v in (a, b)])
    assert new_a != new_b and len(new_a) == len(new_b) == 40_012


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
NEIGHBOURS = [(f"{CARD} 12/26", CARD, ["card"]), (f"{CARD} 123", CARD, ["card"]), (f"{CARD.replace(' ', '-')}-123 x", CARD.replace(" ", "-"), ["card"]),
              (f"pay {IBAN} BIC CAIXESBB", IBAN, ["iban"]), ("call 555-123-4567 120 Main St", "555-123-4567", ["phone"]),
              (f"12 27 {CARD} 9", CARD, ["card"]), (f"{CARD} 129 and {CARD} 12/26, a.b@example.com 2024-02-29", CARD, ["card", "card", "email", "date"]),
              ("000-12-3456 7890 212-555-1234", "212-555-1234", ["phone"]), ("30.02.2024 1 212-555-1234", "212-555-1234", ["phone"]), ("é\U0001f600 " + CARD + " 12 é", CARD, ["card"])]


def test_values_beside_other_numbers_are_found(spark):
    for (text, value, kinds), (new, got) in zip(NEIGHBOURS, replaced(spark, [t for t, _, _ in NEIGHBOURS])):
        assert got == kinds and value not in new and len(new) == len(text), (text, new, got)
        if len(kinds) == 1:
            at = text.index(value)
            assert (new[:at], new[at + len(value):]) == (text[:at], text[at + len(value):])


def test_a_value_beside_numbers_has_the_pseudonym_it_has_alone(spark):
    alone, beside = replaced(spark, [CARD, f"{CARD} 123"])
    assert beside[0] == alone[0] + " 123"


def test_numbers_without_a_valid_value_stay(spark):
    texts = ["4041894974608796", "1234 5678 9012 3456 78", "ES91 2100 0418 4502 0005 1333 BIC", "666-12-1234", "2023-02-29"]
    assert replaced(spark, texts) == [(t, []) for t in texts]


def test_one_invalid_value_among_many_costs_no_more_than_its_place(spark):
    """Twenty thousand addresses, invalid card numbers among them: linear in the text."""
    import time
    address = " ".join(f"10.{i % 250}.{i // 250}.7" for i in range(20_000))
    numbers = " ".join(str(1000 + i % 9000) for i in range(4_000))  # every place could begin a card number
    mixed = f"{address} 1234 5678 9012 3456 78 {CARD} 12/26\n{numbers}"

    def parts(text):
        return spark.createDataFrame([(text,)], "text string").select(pii.parts_of(F.col("text")).alias("p")).first().p

    parts("10.0.0.7 1234 5678 9012 3456 78 " + CARD + " 12/26")
    begin = time.time()
    got = parts(mixed)
    assert time.time() - begin < 60
    # cards among the numbers, at the place where they begin; each value taken passes over those inside it
    found = [(p.m, p.kind) for p in got if p.kind]
    assert [k for _, k in found[:20_000]] == ["ip"] * 20_000 and found[20_000] == (CARD, "card") and {k for _, k in found[20_001:]} <= {"card"}
    assert "".join((p.t or "") + (p.m or "") for p in got) == mixed


def test_the_scan_equals_a_plain_one_from_match_to_match(spark):
    """Random runs of digits and marks against the rule read one character at a time."""
    import random
    rng = random.Random(6)
    tokens = ["4111 1111 1111 1111", "5500-0000-0000-0004", "12", "3456", "x", "-", ",", "a@b.example.com", "10.0.0.1", "2024-02-29", "31.02.2024", "212-555-1234",
              "+44 20 7946 0958", "666-12-1234", "078-05-1120", "ES91 2100 0418 4502 0005 1332", "ES91 2100 0418", "é", "\n", "password=hunter2hunter2"]
    texts = [rng.choice([" ", " ", "", "  "]).join(rng.choice(tokens) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", "text", pii.parts_of(F.col("text")).alias("p"), pii._scanned(F.col("text")).alias("q")).orderBy("i").collect()
    for r in rows:
        whole = lambda parts: ("".join((s.t or "") + (s.m or "") for s in parts), [(s.m, s.kind) for s in parts if s.kind])
        assert whole(r.p) == whole(r.q) and whole(r.q)[0] == r.text
