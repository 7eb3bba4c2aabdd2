import hashlib
import re
from datetime import date, timedelta

import pytest

from tidemark.llm import pseudonyms as P

KEY = "test key"


def feistel(parts, kind):
    now, half = [list(p) for p in parts], -(-len(parts) // 2)
    for r in range(P.ROUNDS):
        left = r % 2 == 0
        other = now[half:] if left else now[:half]
        text = "|".join([KEY, kind, str(len(now)), str(r), ",".join(str(v) for v, _ in other)])
        for i in range(len(now)):
            if (i < half) == left:
                h = hashlib.sha256(f"{text}|{i}".encode()).hexdigest()
                now[i] = [(now[i][0] + int(h[:12], 16)) % now[i][1], now[i][1]]
    return [v for v, _ in now]


def check(nums):
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(nums)))
    return (10 - total % 10) % 10


def spelled(text, kind):
    sets = [next((a for a in (P.DIGITS, P.LOWER, P.UPPER) if c in a), None) for c in text]
    new = feistel([(a.index(c), len(a)) for c, a in zip(text, sets) if a], kind)
    it = iter(new)
    return "".join(a[next(it)] if a else c for c, a in zip(text, sets))


def brute(kind, m):
    if kind == "email":
        local, domain = m.split("@")
        return spelled(local, kind) + "@" + domain
    if kind == "ipv4":
        return ".".join(map(str, feistel([(int(x), 256) for x in m.split(".")], kind)))
    if kind == "phone":
        two = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}
        head = "" if m[0] != "+" else m[:2] if m[1] in "17" else m[:3] if int(m[1:3]) in two else m[:4]
        return head + spelled(m[len(head) :], kind)
    if kind == "iban":
        new = spelled(m[4:], kind)
        number = int("".join(str(int(c, 36)) for c in new.replace(" ", "") + m[:2] + "00"))
        return f"{m[:2]}{98 - number % 97:02}{new}"
    if kind == "card":
        d = [int(c) for c in m if c.isdigit()]
        new = [d[0], *feistel([(x, 10) for x in d[1:-1]], kind)]
        it = iter([*new, check(new)])
        return "".join(str(next(it)) if c.isdigit() else c for c in m)
    if kind == "ssn":
        a, b, c = map(int, m.split("-"))
        a, b, c = feistel([(a - 1 - (a > 666), 898), (b - 1, 99), (c - 1, 9999)], kind)
        return f"{a + 1 + (a + 1 > 665):03}-{b + 1:02}-{c + 1:04}"
    if kind == "date":
        form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y"}.get(m[4] if m[4] == "-" else m[2], "%Y/%m/%d" if m[4] == "/" else "%m/%d/%Y")
        from datetime import datetime

        n = (datetime.strptime(m, form).date() - date(1900, 1, 1)).days
        a, b = feistel([(n // 4297, 17), (n % 4297, 4297)], kind)
        return (date(1900, 1, 1) + timedelta(days=a * 4297 + b)).strftime(form)
    raise AssertionError(kind)


VALUES = [
    ("email", "bosbt.42@mail8.example.com"), ("email", "A_b-C@x.org"), ("ipv4", "42.144.35.254"), ("phone", "+1 (736) 555-2678"), ("phone", "555-123-4567"), ("phone", "+442079460958"), ("phone", "+1 555 123 4567"), ("phone", "+15551234567"), ("phone", "+353 21 1234567"),
    ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"),
    ("card", "4041894974608795"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("ssn", "667-01-0001"), ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "1987/06/05"), ("date", "12/31/2001"),
]
INVALID = ["4041894974608796", "256.1.1.1", "01.2.3.4", "000-12-3456", "2023-02-29", "31.11.1999", "13/31/2001", "2200-01-01", "AA99 1234 5678 9012"]


@pytest.fixture(scope="module")
def run(spark):
    def go(rows):
        df = spark.createDataFrame([(i, t, "c", 9) for i, t in rows], "doc_id long, text string, kinds string, n_values int")
        return [tuple(r) for r in P.pseudonymise(df, KEY).collect()]

    return go


def test_against_brute_force(run):
    rows = [(i, f"Näme: {v}, and {v}.\n{v} x{i}") for i, (_, v) in enumerate(VALUES)]
    got = {r[0]: r for r in run(rows)}
    for i, (kind, v) in enumerate(VALUES):
        new = brute(kind, v)
        assert got[i] == (i, f"Näme: {new}, and {new}.\n{new} x{i}", 3, ",".join([kind] * 3)), (kind, v)
        assert new != v


def test_invalid_values_and_edges(run):
    rows = [(i, f"see {v} here") for i, v in enumerate(INVALID)] + [(None, None), (50, ""), (51, "plain words, 3.5 and 12"), (52, "word " * 30000 + VALUES[0][1]), (51, "plain words, 3.5 and 12")]
    got = run(rows)
    assert sorted(got, key=repr) == sorted([(i, t, 0, "") for i, t in rows if i != 52] + [(52, "word " * 30000 + brute(*VALUES[0]), 1, "email")], key=repr)
    assert run([]) == []


def test_neighbours_and_iban(run):
    text = "+1 (269) 555-3296 4524132264652876 or +1 (383) 555-6083 42.144.35.254 ogn.33@mail1.example.com GB82 WEST 1234 5698 7654 32"
    (_, out, n, kinds) = run([(1, text)])[0]
    assert [k for k in kinds.split(",") if k != "card"] == ["phone", "phone", "ipv4", "email", "iban"]
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d$", out)[0]
    compact = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    assert iban != "GB82 WEST 1234 5698 7654 32"
    assert out.split("@")[1] == "mail1.example.com " + iban


def test_one_number_in_several_spellings(run):
    got = run([(0, "+1 555 123 4567"), (1, "+15551234567"), (2, "+1 (555) 123-4567"), (3, "555-123-4567")])
    assert len({re.sub(r"\D", "", r[1]).removeprefix("1") if r[0] < 3 else re.sub(r"\D", "", r[1]) for r in got}) == 1


def test_permutation(run):
    """Of many dates no two pseudonyms meet."""
    days = [(i, (date(1900, 1, 1) + timedelta(days=i)).isoformat()) for i in range(0, 73049, 37)]
    got = run(days)
    assert len({r[1] for r in got}) == len(days) and all(r[3] == "date" for r in got)
