import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import pii, queries

from .helpers import awkward, nothing


def permuted(values, bases, key, tweak):
    """The network in plain Python."""
    v, half = list(values), len(values) // 2
    for r in range(1, pii.ROUNDS + 1):
        odd = r % 2 == 1
        other = ",".join(str(x) if (i < half) != odd else "" for i, x in enumerate(v))
        stream = "".join(hashlib.sha512(f"{key}|{tweak}|{r}|{len(v)}|{other}|{n}".encode()).hexdigest() for n in range(-(-len(v) // 32)))
        v = [(x + int(stream[4 * i : 4 * i + 4], 16)) % b if (i < half) == odd and b > 1 else x for i, (x, b) in enumerate(zip(v, bases))]
    return v


def luhn_ok(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d >= 5 else 2 * d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text, key):
    """Finds and pseudonyms of a text in plain Python."""
    finds = []
    tens = lambda v: [10] * len(v)
    numbers = lambda t: [int(c) for c in t if c in "0123456789"]

    def refill(t, digits):
        rest = iter(digits)
        return "".join(str(next(rest)) if c in "0123456789" else c for c in t)

    def moved(t):
        whole = lambda pattern: re.fullmatch(pattern, t)
        if "@" in t:
            local, domain = t.split("@")
            classes = [next(((low, n) for low, n, last in ((48, 10, 57), (65, 26, 90), (97, 26, 122)) if low <= ord(c) <= last), (ord(c), 1)) for c in local]
            v = permuted([ord(c) - low for c, (low, _) in zip(local, classes)], [n for _, n in classes], key, "email")
            return "email", "".join(chr(x + low) for x, (low, _) in zip(v, classes)) + "@" + domain
        if whole(pii.IPV4):
            octets = [int(x) for x in t.split(".")]
            return ("ipv4", ".".join(map(str, permuted(octets, [256] * 4, key, "ipv4")))) if max(octets) < 256 else None
        if whole(pii.DATE):
            form = "%Y-%m-%d" if "-" in t else "%d.%m.%Y" if "." in t else "%d/%m/%Y"
            try:
                day = datetime.datetime.strptime(t, form).date()
            except ValueError:
                return None
            if not 1700 <= day.year <= 2099:
                return None
            n = (day - datetime.date(1700, 1, 1)).days
            a, b = permuted([n // 773, n % 773], [189, 773], key, "date")
            return "date", (datetime.date(1700, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(form)
        if whole(pii.SSN):
            a, g, n = map(int, t.split("-"))
            if not 1 <= a <= 899 or a == 666 or not g or not n:
                return None
            areas = [x for x in range(1, 900) if x != 666]
            a, g, n = permuted([areas.index(a), g - 1, n - 1], [898, 99, 9999], key, "ssn")
            return "ssn", f"{areas[a]:03}-{g + 1:02}-{n + 1:04}"
        if whole(pii.PHONE):
            d = numbers(t)
            return "phone", refill(t, permuted(d, [1 if i < len(d) - 10 else 10 for i in range(len(d))], key, "phone"))
        if whole(pii.NUMBER):
            d = numbers(t)
            if not luhn_ok(d):
                return None
            p = permuted(d[:-1], tens(d[:-1]), key, "number")
            return "number", refill(t, p + [next(x for x in range(10) if luhn_ok([*p, x]))])
        if whole(pii.SECRET):
            v = permuted([int(c, 16) for c in t], [16] * len(t), key, "secret")
            out = "".join(f"{x:x}" for x in v)
            return "secret", out.upper() if re.search("[A-F]", t) else out
        bare = lambda x: x.replace(" ", "")
        remainder = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if remainder(bare(t)) != 1:
            return None
        d = numbers(t)
        blank = refill(t, [0, 0, *permuted(d[2:], tens(d[2:]), key, "iban")])
        return "iban", blank[:2] + f"{98 - remainder(bare(blank)):02}" + blank[4:]

    def replace(m):
        found = moved(m[0])
        if not found and re.fullmatch(pii.IBAN, m[0]):  # no IBAN: what else is in it?
            return re.sub("|".join((pii.SSN, pii.PHONE, pii.NUMBER)), replace, m[0])
        finds.extend([found] if found else [])
        return found[1] if found else m[0]

    return (None if text is None else re.sub(pii.ANY, replace, text)), finds


def test_the_whole_query_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = ["GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, 31.12.1999 29/02/1980 1999-02-29 123-45-6789 900-11-2222", "ABCDEF0123456789ABCDEF0123456789 3782 822463 10005 x", "", None]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(extra, 1)], "doc_id long, text string"))
    rows = {(r.doc_id, r.text, tuple((f.kind, f.pseudonym) for f in r.finds)) for r in pii.pseudonyms(both, "key").collect()}
    expected = {(r.doc_id, *(lambda t, f: (t, tuple(f)))(*plain(r.text, "key"))) for r in both.collect()}
    assert rows == expected and len({k for _, _, finds in rows for k, _ in finds}) == 8


def run(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonyms(df, key).orderBy("doc_id").collect()]


def test_network_matches_plain_python_and_permutes(spark):
    rows = [([a, b, c],) for a in range(5) for b in range(3) for c in range(7)]
    df = spark.createDataFrame(rows, "v array<int>")
    out = [tuple(r.p) for r in df.select(pii.permute(F.col("v"), F.array(F.lit(5), F.lit(3), F.lit(7)), "key", "t").alias("p")).collect()]
    assert out == [tuple(permuted(v, [5, 3, 7], "key", "t")) for (v,) in rows]
    assert len(set(out)) == len(rows)


def test_numbers_keep_format_and_validity(spark):
    (valid,) = run(spark, "4111 1111 1111 1111")
    assert re.fullmatch(r"\d{4}( \d{4}){3}", valid) and luhn_ok([int(c) for c in valid if c.isdigit()])
    assert valid != "4111 1111 1111 1111"


def test_social_security_numbers_stay_issuable(spark):
    numbers = [f"{a:03}-{g:02}-{n:04}" for a in (1, 2, 665, 667, 899) for g in (1, 50, 99) for n in (1, 4321, 9999)]
    out = run(spark, *numbers)
    assert len(set(out)) == len(numbers) and out != numbers
    for t in out:
        a, g, n = map(int, t.split("-"))
        assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", t) and 1 <= a <= 899 and a != 666 and g and n


def test_numbers_that_fail_luhn_stay(spark, tmp_path):
    cards = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "3782 822463 10005"]
    decoys = ["4111-1111-1111-1112", "9807915762804490", "7086638319846192", "3782 822463 10006"]
    docs = spark.createDataFrame([(1, " x ".join(decoys)), (2, " ".join(f"a {c} b {d}." for c, d in zip(cards, decoys)))], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean, mixed = queries.op1_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert clean.text == " x ".join(decoys) and clean.n_finds == 0
    assert mixed.kinds == "number number number number"
    assert all(d in mixed.text for d in decoys) and not any(c in mixed.text for c in cards)


def test_same_value_same_pseudonym_other_key_other(spark):
    a, b = run(spark, "see 97.51.17.173.", "97.51.17.173 again")
    assert a[4:-1] == b[:-6] != "97.51.17.173"
    assert all(int(o) < 256 for o in a[4:-1].split("."))
    assert run(spark, "see 97.51.17.173.", key="other")[0] != a


def test_dates_are_a_permutation_of_real_days(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(0, 1500)]
    out = run(spark, *[d.isoformat() for d in days])
    assert len({datetime.date.fromisoformat(t) for t in out}) == len(days)
    assert run(spark, "29.02.1980", "1980-02-29")[0].split(".")[::-1] == run(spark, "29.02.1980", "1980-02-29")[1].split("-")


def test_iban_stays_valid(spark):
    out = run(spark, "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000")
    for t, was in zip(out, ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000")):
        bare = t.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        assert t != was and [len(x) for x in t.split()] == [len(x) for x in was.split()]


@pytest.mark.parametrize("text", ["no digits here", "version 4.0. and 3.", "999.1.1.1", "29/02/1981", "DE88370400440532013000", "", "2024-13-01", "1.2.3.4.5", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "order 1700000000000", "4111-1111-1111-1112"])
def test_what_fails_validation_stays(spark, text):
    assert run(spark, text) == [text]


def test_kinds(spark):
    text = 'jane.doe+x@mail7.example.com +1 (017) 555-7713 123-45-6789 token "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" 4111111111111111'
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.pseudonyms(df, "k").first()
    assert [f.kind for f in row.finds] == ["email", "phone", "ssn", "secret", "number"]
    assert row.text.split("@")[1].startswith("mail7.example.com +1 (")
    assert all(x not in row.text for x in ("jane.doe", "555-7713", "123-45-6789", "b44e15e0", "4111111111111111"))
    assert all(f.pseudonym in row.text for f in row.finds)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = {(r.doc_id, r.text) for r in pii.pseudonyms(docs, "k").collect()}
    assert len(out) == len({(r.doc_id, r.text) for r in docs.collect()})
    assert (1, None) in out and (2, "") in out
    kept = pii.pseudonymise(docs.drop("finds", "_found"), "k")
    assert set(docs.columns) - {"_found"} <= set(kept.columns)
    assert pii.pseudonyms(nothing(spark), "k").collect() == []


def test_long_runs_take_no_longer_than_their_length(spark):
    out = run(spark, "a" * 200_000, "1" * 200_000, "a.b@" * 50_000)
    assert out[0] == "a" * 200_000 and out[1] == "1" * 200_000


@pytest.mark.parametrize(
    "text, secret, kinds",
    [
        ("pay XY12 4111 1111 1111 1111 now", "4111 1111 1111 1111", ["number"]),
        ("ref AB12 4111111111111111", "4111111111111111", ["number"]),
        ("key abcdefabcdefabcdefabcdefabcdefab end", "abcdefabcdefabcdefabcdefabcdefab", ["secret"]),
        ("key ABCDEFABCDEFABCDEFABCDEFABCDEFAB end", "ABCDEFABCDEFABCDEFABCDEFABCDEFAB", ["secret"]),
        ("key abcdefabcdefabcdefabcdefabcdefab end 1", "abcdefabcdefabcdefabcdefabcdefab", ["secret"]),
    ],
)
def test_nothing_hides_in_a_failed_candidate_or_behind_a_filter(spark, text, secret, kinds):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.pseudonyms(df, "k").collect()
    assert secret not in row.text and len(row.text) == len(text) and [f.kind for f in row.finds] == kinds and row.finds[0].pseudonym in row.text


def test_long_secrets_keep_no_difference_of_their_digits(spark):
    import random

    rng = random.Random(5)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(128)) for _ in range(300)]
    same = [0] * 64
    for before, after in zip(secrets, run(spark, *secrets)):
        x, y = ([int(c, 16) for c in t] for t in (before, after))
        for i in range(64):
            i_, j = (i, i + 32) if i < 32 else (i + 32, i + 64)  # digits of one half, 32 apart
            same[i] += (x[j] - x[i_]) % 16 == (y[j] - y[i_]) % 16
    assert max(same) < 60  # by chance one in sixteen: 19 of 300
