import hashlib
import random
import re
import time

import pytest

from shardflow.llm import pii
from shardflow.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            checked = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if checked:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_plain_finds_of_whole_table(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in QUERIES["op8_pii"](spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in want) for kind in PATTERNS)
        spans = [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(spans)


def test_plain_finds_of_random_texts():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice("a@.1 2-+(9_é7") for _ in range(rng.randrange(40)))
        assert pii.ordered(pii.plain(text)) == brute(text), text


FOUND = [
    ("email", "write to <john.doe [at] example [dot] com> now", "john.doe [at] example [dot] com"),
    ("email", "so john dot doe at example dot com, please", "john dot doe at example dot com"),
    ("email", "jane(at)mail.example.org", "jane(at)mail.example.org"),
    ("email", "x jane @ example.com", "jane @ example.com"),
    ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "mail jоhn@exаmple.com", "jоhn@exаmple.com"),
    ("email", "user@mail.example dot com", "user@mail.example dot com"),
    ("phone", "call plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven"),
    ("card", "no four one one one one one one one one one one one one one one one", "four one one one one one one one one one one one one one one one"),
    ("card", "٤١١١ ١١١١ ١١١١ ١١١١", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("card", "4111​1111 1111-1111", "4111​1111 1111-1111"),
    ("ip", "at one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one"),
]


@pytest.mark.parametrize("kind,text,part", FOUND)
def test_disguises(kind, text, part):
    found = pii.disguised(text, pii.plain(text))
    assert (kind, text.index(part), text.index(part) + len(part)) in found


CLEAN = ["look at example.com and go", "it is at home dot the end", "one of two or three, four at most", "Étre à la maison, über ñ", "we met at noon. One two three."]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert pii.plain(text) + pii.disguised(text, []) == []


PROSE = [
    "we looked at this point in time and left",
    "they stay at some point in the year",
    "he stopped at each point us and them",
    "rates rose at every point de facto",
    "stay at home dot inside",
    "we stay at home dot in the evening",
    "look at the dot in the middle",
    "she worked at a dot com startup",
    "so en punto at sol punto de vista",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_with_bare_signs_stays_clean(text):
    assert pii.plain(text) + pii.disguised(text, []) == []


SPOKEN = [
    "jane at example [point] com",
    "jane at firma [punkt] de",
    "jane at example dot co [dot] in",
    "john dot doe at mail dot example dot org",
    "jane at example dot co dot in",
    "jane at example dot co dot uk",
    "jane(at)firma punkt de",
]


@pytest.mark.parametrize("part", SPOKEN)
@pytest.mark.parametrize("after", ["", ", please", ".", "\nthen", " - then"])
def test_spoken_addresses_are_found(part, after):
    text = f"write: {part}{after}"
    assert ("email", 7, 7 + len(part)) in pii.disguised(text, pii.plain(text))


@pytest.mark.parametrize("after", ["", ", please", ".", "\nthen"])
def test_common_words_end_an_address_where_the_clause_ends(after):
    part = "max at firma dot de"
    assert ("email", 7, 7 + len(part)) in pii.disguised(f"write: {part}{after}", [])


def test_prose_is_not_redacted(spark):
    df = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert [r.redacted for r in pii.redacted(pii.personal_data(df)).orderBy("doc_id").collect()] == PROSE


def test_clean_documents_get_nothing_added(documents):
    rows = pii.personal_data(documents).collect()
    assert sum(not s.plain for r in rows for s in r.spans) == 0


def test_odd_rows_redaction_and_empty_table(spark, odd, odd_rows, nothing):
    assert sorted(len(r.spans) for r in pii.personal_data(odd).collect()) == [0] * len(odd_rows)
    assert pii.personal_data(nothing).collect() == []
    df = spark.createDataFrame([(1, "a@b.co, +1 555 123 4567!"), (2, None), (3, "u@m.example dot com.")], "doc_id long, text string")
    out = {r.doc_id: r.redacted for r in pii.redacted(pii.personal_data(df)).collect()}
    assert out == {1: "[email], [phone]!", 2: "", 3: "[email]."}


@pytest.mark.parametrize("dot", [".", " [dot] ", " dot ", "_dot_"])
@pytest.mark.parametrize("parts", [1, 6, 20, 500])
def test_any_number_of_dotted_parts(dot, parts):
    for sign in (" [at] example [dot] com", " at example dot com"):
        part = dot.join(f"p{k}" for k in range(parts)) + sign
        assert pii.disguised(f"write: {part}, please", []) == [("email", 7, 7 + len(part))], part


def test_neighbouring_addresses_do_not_share_parts():
    first, second = "ann [at] example [dot] com", "bob dot lee (at) mail dot example dot org"
    text = f"{first} {second}"
    assert sorted(pii.disguised(text, [])) == [("email", 0, len(first)), ("email", len(first) + 1, len(text))]
    assert pii.disguised(" [at] example [dot] com", []) == []


def test_outermost_against_all_pairs():
    rng = random.Random(8)
    span = lambda: (rng.choice(("email", "ip")), a := rng.randrange(12), a + rng.randrange(1, 6))
    for _ in range(3000):
        found, known = {span() for _ in range(rng.randrange(8))}, [span() for _ in range(rng.randrange(4))]
        inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
        want = {f for f in found if not any(inside(f, k) for k in known) and not any(g != f and inside(f, g) for g in found)}
        got = pii.outermost(found, known)
        assert set(got) == want and len(got) == len(want)


def test_long_runs_take_linear_time():
    many = "é ехample " + " ".join(f"user{k}@example{k}.com" for k in range(50_000))
    dotted = ".".join(["a"] * 100_000) + " [at] example [dot] com"
    spelled = "a dot " * 40_000 + "b [at] example [dot] com"
    repeated = "jane [at] example [dot] com " * 20_000
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@a" * 100_000, "+1" * 100_000, "at " * 60_000, "one " * 40_000, "a at b dot " * 15_000, many, dotted, spelled, repeated):
        start = time.perf_counter()
        pii.disguised(text, pii.plain(text))
        assert time.perf_counter() - start < 10, text[:40]
