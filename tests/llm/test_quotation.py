"""Quotation linking: small conversations with known links, against a plain version, and odd rows."""

import re
from collections import Counter

from rasterloom.llm import quotation as Q
from rasterloom.llm.oracles import ORACLES

from .conftest import SF


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def linked(spark, rows):
    return {(r.conv_id, r.turn): r for r in Q.link_quotes(frame(spark, rows)).collect()}


def test_links_and_texts(spark):
    rows = [
        (1, 0, "a", "Where is the harbour?\n\nAnd when does it open?"),
        (1, 1, "b", "On Monday, a wrote:\n> Where is  the HARBOUR?\n\nBy the old bridge."),
        (1, 2, "c", "> And when does it open?\nAt nine."),
        (1, 3, "d", ">> Where is the harbour?\n> By the old bridge.\n\nThank you."),
        (1, 4, "e", "> never said\nNothing."),
        (2, 0, "f", "> By the old bridge.\nFrom another thread."),
        (3, 0, "g", "No quotes > at all"),
    ]
    found = linked(spark, rows)
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in found.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (None, None), (2, 0): (1, 1), (3, 0): (None, None)}
    assert {k: r.text for k, r in found.items()} == {(1, 0): rows[0][3], (1, 1): "By the old bridge.", (1, 2): "At nine.", (1, 3): "Thank you.", (1, 4): "Nothing.", (2, 0): "From another thread.", (3, 0): "No quotes > at all"}
    assert found[1, 3].n_quotes == 2 and found[1, 3].n_linked == 2 and found[1, 4].n_quotes == 1 and found[1, 4].n_linked == 0
    assert {k: r.depth for k, r in found.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 0, (2, 0): 2, (3, 0): 0}
    assert {k: r.thread_id for k, r in found.items()} == {(1, i): 1 for i in range(5)} | {(2, 0): 1, (3, 0): 3}
    order = [(r.conv_id, r.turn) for r in Q.reply_ordered(frame(spark, rows)).collect()]
    assert order == [(1, 0), (1, 1), (1, 3), (2, 0), (1, 2), (1, 4), (3, 0)]


MANY = [
    (1, 0, "a", "Where is the harbour?\n\nAnd when does it open?"),
    (1, 1, "b", "On Monday, a wrote:\n> Where is  the HARBOUR?\n\nBy the old bridge."),
    (1, 2, "c", "> And when does it open?\nAt nine.\n\n\n> never said\n>> By the old bridge."),
    (1, 3, "d", ">> Where is the harbour?\n> By the old bridge.\n\nThank you."),
    (1, 3, "d", ">> Where is the harbour?\n> By the old bridge.\n\nThank you."),
    (2, 0, "f", "> By the old bridge.\nFrom another thread.\n > Where is the harbour?\n\t>\tAnd when does it open?"),
    (2, 1, "f", "> From another thread.\n\n> > Thank you.\n\nDeep."),
    (3, 0, "g", "No quotes > at all"),
    (3, 1, None, None),
    (3, 2, "g", ""),
    (3, 3, "g", ">\n>>\n"),
    (4, 0, "h", "> Deep.\nDeeper."),
    (4, 1, "h", "> Deeper.\n> Deep.\nNo such passage."),
    (None, 1, "u", "> Deep.\nNowhere."),
    (5, None, "u", "> Deep.\nNever."),
]


def test_against_sql(spark):
    import duckdb
    import pandas as pd

    frame_ = pd.DataFrame(MANY, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    base = duckdb.connect()
    base.register("conversations", frame_)
    expected = base.sql(ORACLES["op8_quotation"])
    found = Q.reply_ordered(frame(spark, MANY))
    assert found.columns == expected.columns
    assert Counter(map(tuple, found.collect())) == Counter(expected.fetchall())


def test_a_long_chain(spark):
    rows = [(7, 0, "u", "message 0")] + [(7, i, "u", f"> message {i - 1}\nmessage {i}") for i in range(1, 40)]
    found = linked(spark, rows)
    assert [found[7, i].depth for i in range(40)] == list(range(40))
    assert all(found[7, i].text == f"message {i}" for i in range(40))
    assert len(found[7, 39].reply_path.split("/")) == 40


def test_a_phrase_that_all_quote(spark):
    rows = [(0, 0, "u", "same words")] + [(i, 1, "u", "> same words\nsame words") for i in range(300)]
    found = linked(spark, rows)
    assert all((r.parent_conv, r.parent_turn, r.thread_id) == (0, 0, 0) for k, r in found.items() if k != (0, 0))


def test_odd_rows(spark):
    rows = [(None, 1, "u", "> x"), (1, None, None, "x"), (None, None, None, None), (1, 0, "u", None), (1, 1, "u", ""), (2, 0, "u", "x"), (2, 0, "u", "x"), (2, 0, "u", "y"), (2, 1, "u", "> y\nz"), (2, 2, "u", ">\n> \n>>>"), (2, 3, "u", "> " + "w " * 50_000)]
    found = Q.link_quotes(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if (r.conv_id, r.turn) == (1, 0)] == [None]
    assert [r.text for r in found if (r.conv_id, r.turn) == (1, 1)] == [""]
    assert [(r.text, r.parent_turn) for r in found if (r.conv_id, r.turn) == (2, 1)] == [("z", 0)]
    assert [r.text for r in found if (r.conv_id, r.turn) == (2, 2)] == [""]
    assert Q.reply_ordered(frame(spark, rows).where("false")).count() == 0


def test_clashing_columns(spark):
    rows = frame(spark, [(1, 0, "a", "x"), (1, 1, "b", "> x\ny")]).selectExpr("*", "1 as h", "2 as sum", "3 as part", "4 as level", "5 as own", "6 as path")
    assert sorted((r.turn, r.text, r.depth) for r in Q.link_quotes(rows).collect()) == [(0, "x", 0), (1, "y", 1)]


def test_plans_hold_no_python(spark):
    plan = Q.link_quotes(frame(spark, [(1, 0, "a", "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def test_whole_table(spark):
    """Every message once, quoted lines gone, every parent earlier than its reply."""
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    found = Q.reply_ordered(table).collect()
    assert len(found) == table.count()
    for r in found:
        assert r.text is None or not re.search(r"(?m)^[ \t]*>", r.text)
        if r.parent_conv is not None:
            assert (r.parent_conv, r.parent_turn) < (r.conv_id, r.turn)
