import random

import duckdb
import pyarrow as pa
from starloom.llm.quote_links import OP1_SQL, link_quotations

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt holds numbers."),
    (1, 1, "assistant", "Use the built-in sort.\nIt is stable."),
    (1, 2, "user", "On Monday, A. B. wrote:\n> How do I sort a list?\n> It holds numbers.\n\nI found it myself."),
    (1, 3, "assistant", "> On Monday, A. B. wrote:\n>> How do I   SORT a list\n> I found it myself.\nGood."),
    (1, 4, "user", ">>> deep thing nobody said\n> It is stable!\nThanks"),
    (1, 5, "user", "> Good.\nyes\n> Thanks\n"),
    (2, 0, "user", "> Use the built-in sort.\nIs that so?"),
    (2, 1, "user", "> never said anywhere\nplain"),
    (2, 1, "user", "> never said anywhere\nplain"),  # a repeated row
    (2, 2, None, None),
    (2, 3, "user", ""),
    (None, 0, "user", "> It is stable.\nlost"),
    (3, None, "user", "> It is stable.\nno turn"),
    (3, 0, "user", "> > >"),
]


def rows_of(frame):
    return sorted((tuple(r) for r in frame), key=repr)


def test_against_sql_and_by_hand(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    found = link_quotations(frame).collect()
    conversations = pa.table({n: pa.array([r[i] for r in ROWS], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    columns = found[0].asDict().keys()
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({OP1_SQL})").fetchall()
    assert rows_of(found) == rows_of(expected)

    by = {(r.conv_id, r.turn): r for r in found}
    assert by[1, 2].body == "I found it myself." and by[1, 2].parent_turn == 0 and by[1, 2].n_quotes == 1
    assert (by[1, 3].parent_turn, by[1, 3].depth, by[1, 3].root_turn, by[1, 3].max_level) == (2, 2, 0, 2)
    assert by[1, 4].parent_turn == 1
    assert (by[1, 5].parent_turn, by[1, 5].n_linked) == (3, 2)
    assert (by[2, 0].source_conv, by[2, 0].source_turn, by[2, 0].parent_turn) == (1, 1, None)
    assert by[2, 1].n_linked == 0 and len([r for r in found if (r.conv_id, r.turn) == (2, 1)]) == 2
    for r in found:  # replies come after what they answer
        if r.parent_turn is not None:
            assert by[r.conv_id, r.parent_turn].position < r.position


def against_sql(spark, rows):
    found = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    conversations = pa.table({n: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    expected = con.sql(f"SELECT {', '.join(found[0].asDict())} FROM ({OP1_SQL})").fetchall()
    assert rows_of(found) == rows_of(expected)
    return {(r.conv_id, r.turn): r for r in found}


def test_the_message_that_was_quoted_is_found(spark):
    rows = [
        (1, 1, "u", "Hi all\nRegards"), (1, 3, "u", "Hi all\nanswer\nRegards"), (1, 4, "u", "> Hi all\n> answer\n> Regards\nyes"),  # not the first that greets
        (1, 5, "u", "> Hi all\n> Regards\nlate"),  # the whole block is turn 1's
        (1, 6, "u", "> Hi all\n> [...]\n> answer\nok"),  # most lines are turn 3's
        (2, 5, "u", "a passage"), (2, 3, "u", "> a passage\nwhence?"), (3, 1, "u", "a passage"),  # its own conversation has it only later
        (4, 0, "u", "first\nsecond"), (4, 1, "u", "first\nsecond"), (4, 2, "u", "> first\n> second\nwhich?"),  # the nearest of equals
    ]
    by = against_sql(spark, rows)
    assert [by[1, t].parent_turn for t in (4, 5, 6)] == [3, 1, 3] and (by[2, 3].source_conv, by[2, 3].source_turn) == (3, 1) and by[4, 2].parent_turn == 1


def test_many_generated_messages(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for conv in range(60):
        said = []
        for turn in range(30):
            lines = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))] + rng.choice([[], ["Hi all"], ["Regards"]])
            text = list(lines)
            for _ in range(rng.choice([0, 0, 1, 2])):
                if said:
                    depth, whose = rng.randint(1, 3), rng.choice(said if rng.random() < 0.9 else [["nobody said", "this"]])
                    part = whose if rng.random() < 0.6 else rng.sample(whose, rng.randint(1, len(whose)))
                    if rng.random() < 0.3:  # re-wrapped
                        part = [" ".join(part)]
                    text = rng.choice([["On Monday, A wrote:"], []]) + ["> " * depth + x.upper() + rng.choice(["", "!"]) for x in part] + text
            said.append(lines)
            rows.append((conv, turn, rng.choice(["u", "a", None]), "\n".join(text)))
    rows += rng.sample(rows, 20) + [(None, 1, "u", "> Hi all"), (5, None, "u", "> Regards\nx"), (5, 3, "u", None), (5, 3, "u", "x" * 50_000 + "\n> Hi all\n" + "\n".join(f"{'>' * (i % 5)} w{i}" for i in range(3000)))]
    by = against_sql(spark, rows)
    assert sum(r.parent_turn is not None for r in by.values()) > 300


def test_one_long_thread(spark):
    rows = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "'u' AS role", "if(id = 0, 'the root', concat('> the root\n', 'reply ', id)) AS text")
    found = link_quotations(rows)
    summary = found.selectExpr("count(*)", "count(distinct position)", "max(position)", "max(depth)", "sum(int(parent_turn = 0))").first()
    assert tuple(summary) == (100_000, 100_000, 100_000, 1, 99_999)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", body string, position long")
    assert link_quotations(empty).count() == 0
    frame = spark.createDataFrame([(1, 0, "u", "a", "clash", 5)], SCHEMA + ", body string, position long")
    assert link_quotations(frame).first().body == "a"


def test_a_long_chain_and_a_hot_line(spark):
    rows = [(1, i, "u", f"> message number {i - 1}\nmessage number {i}" if i else "message number 0") for i in range(40)]
    rows += [(7 + i, 0, "u", "the same first line") for i in range(500)] + [(6, 1, "u", "> the same first line\nok")]
    found = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    assert (found[1, 39].depth, found[1, 39].root_turn, found[1, 39].position) == (39, 0, 40)
    assert (found[6, 1].source_conv, found[6, 1].source_turn) == (7, 0)
