"""Chat formatting against a plain version, round trips, and the SQL."""

import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stridelake.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
#: Pieces of control strings, and what may stand around them.
PIECES = ("\\", "#", "##", "###", "### ", "</turn>", "</tur", "n>", "\\b", "\\h", "\\e", "\\c", ": ", ":", " ", "\n", "é", "😀", "a", "", "assistant")
TEXTS = st.lists(st.sampled_from(PIECES), max_size=6).map("".join)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """conv_id -> digests, by a loop; rows sorted by turn (null first), role and text as escaped."""

    def esc(x, escapes):
        for a, b in escapes:
            x = x.replace(a, b)
        return x

    rows = [(i, t, r or "", x or "") for i, t, r, x in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, esc(r[2], chat_format.ESCAPES), esc(r[3], chat_format.ESCAPES[:-1])))
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        trained = "".join(x for _, _, r, x in own if r == "assistant")
        out[conv] = (len(own), sha(said), len(trained), sha(trained))
    return out


def digests(df, **more):
    got = chat_format.chat_digests(chat_format.write_chats(df, **more))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()}


def test_edges(spark):
    rows = [*chat_format.PROBE, (1, None, "user", None), (1, 3, "user", "b ### b\\"), (1, 3, "user", "b ### b\\"), (1, 2, None, "x</turn"), (2, 0, "assistant: ### x", ""), (2, 1, "assistant", ""), (None, 0, "assistant", "é😀x"), (None, None, None, None)]
    rows += [(3, t, "assistant" if t % 7 > 2 else "user", f"turn {t} ") for t in range(1500)] + [(4, 0, "user", "long # " * 60_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "1 AS formatted", "2 AS runs", "3 AS t")
    assert digests(df) == plain(rows)
    # a conversation is split into parts of bounded turns, whatever its length
    assert digests(df, part_turns=10) == plain(rows)
    assert chat_format.chat_format(df, part_turns=10).where("conv_id = 3").count() == 150
    assert digests(spark.createDataFrame([], SCHEMA)) == {}


def test_adjacent_turns_of_one_role_share_a_header(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = chat_format.chat_format(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "### user: a</turn>b</turn>\n### assistant: c</turn>d</turn>\n### user: e</turn>\n"
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss] == ["c", "d"]
    both = chat_format.chat_format(spark.createDataFrame(rows, SCHEMA), loss_roles=("user", "assistant")).first()
    assert [both.formatted[s.start : s.start + s.length] for s in both.loss] == list("abcde")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.one_of(st.sampled_from(["user", "assistant", None]), TEXTS), st.one_of(TEXTS, st.none())), min_size=1, max_size=25))
def test_round_trip(spark, rows):
    assert digests(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_no_python_in_the_plan(spark):
    df = queries.op13_chat_format(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_chat_format"])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.op13_chat_format(spark, SF).collect()) == sorted(want.fetchall())
