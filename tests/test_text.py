import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Blue KETTLE", ["blue", "kettle"]),
        ("pump_2 (v0.9.31) <= 7%", ["pump_2", "v0", "9", "31", "7"]),
        ("北方冬天", ["北方", "方冬", "冬天"]),
        ("雪", ["雪"]),
        ("kettle北方x", ["kettle", "北方", "x"]),
        ("?! ... +", []),
        ("", []),
    ],
)
def test_tokens(spark, text, tokens):
    assert value(spark, tx.tokens(F.lit(text))) == tokens


def test_trimming_takes_every_kind_of_white_space(spark):
    for text in ("coat", " \t\n coat \u3000\ufeff\u00a0", "  coat", "coat\r\n"):
        assert value(spark, tx.trimmed(F.lit(text))) == "coat"
    assert value(spark, tx.trimmed(F.lit(" a \t b "))) == "a \t b" and value(spark, tx.trimmed(F.lit(" \n "))) == ""


def test_keyword_tokens(spark):
    assert value(spark, tx.keyword_tokens(F.lit("Blue 北方 kettle kettle"))) == ["blue", "北", "方", "kettle", "kettle"]


@pytest.mark.parametrize("query, bucket", [("", "empty"), (" \t ", "empty"), ("雪", "<=8"), ("a" * 8, "<=8"), ("a" * 9, "9-24"), ("a" * 24, "9-24"), ("a" * 25, ">24")])
def test_length_bucket(spark, query, bucket):
    assert value(spark, tx.length_bucket(F.lit(query))) == bucket


@pytest.mark.parametrize("query, shape", [("雪", "terse-cjk"), ("kettle", "terse-cjk"), ("北方冬天 coat and boots 雪 please", "mixed"), ("北方的冬天下雪的时候应该穿什么衣服出门", "cjk-only"), ("what coat to wear in snow", "latin")])
def test_shape(spark, query, shape):
    assert value(spark, tx.query_shape(F.lit(query))) == shape


NOISE = {
    "too short": "coat",
    "too long": "coat " * 90,
    "an absolute path": "/srv/coats/winter/list",
    "a path of the home folder": "~/coats/winter.txt",
    "a path with a drive": "D:\\coats\\winter.txt",
    "a command": "/list-coats",
    "marks alone": "=== *** ===",
    "a JSON object": '{"coat": 7, "boots": 9}',
    "a bracketed tag before a path": "[coats] look at store/winter/list",
    "an error with a path": "error at line 7 in /srv/coats",
    "four numbered points": "1. hat 2. coat 3. boots 4. gloves",
    "a task": "Task: fold the coats",
    "a role": "You are an agent that folds coats",
    "a prescribed answer": "Reply with exactly: coat",
    "a quoted path": '"/srv/coats/winter"',
}


@pytest.mark.parametrize("query", NOISE.values(), ids=NOISE)
def test_noise(spark, query):
    assert value(spark, tx.is_noise(F.lit(query)))


@pytest.mark.parametrize("query", ["which coat did I buy for the snow", "北方的冬天要穿什么衣服", "why is there an error in the coat's size", "1. the only point of the list"])
def test_not_noise(spark, query):
    assert not value(spark, tx.is_noise(F.lit(query)))


def test_clamp_at_and_above_the_cap(spark):
    for n, cut in ((4000, None), (4001, (4001, 4000))):
        row = spark.range(1).select(tx.clamped(F.lit("x" * n)).alias("t"), tx.overflow(F.lit("x" * n)).alias("o")).first()
        assert len(row.t) == min(n, 4000) and (row.o and tuple(row.o)) == cut


def test_scope_label(spark):
    label = tx.scope_label(F.create_map(F.lit("user_id"), F.lit("mia"), F.lit("app_id"), F.lit("shop")))
    assert value(spark, label) == "app_id=shop user_id=mia"
    assert value(spark, tx.scope_label(F.lit(None).cast("map<string,string>"))) == "unscoped"
