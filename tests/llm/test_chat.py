from collections import defaultdict

from compare import compare, connect

from cellweave.llm import chat as C

SCHEMA = "conv_id bigint, turn int, role string, text string"


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t, r, x))
    lists = {c: [(r, x) for _, r, x in sorted(v, key=lambda i: (i[0] is not None, i[0] or 0, i[1] or ""))] for c, v in convs.items()}
    kept = {}
    for c in sorted(lists, key=lambda c: (c is None, c or 0)):
        v = lists[c]
        if any(len(o) > len(v) and o[: len(v)] == v for o in lists.values()) or v in kept.values():
            continue
        kept[c] = v
    return {c: "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in v) for c, v in kept.items()}


def formatted(spark, rows, block=C.BLOCK_TURNS):
    got = C.format_chats(spark.createDataFrame(rows, SCHEMA), block_turns=block).orderBy("segment").collect()
    out = defaultdict(str)
    for r in got:
        out[r.conv_id] += r.chat
    return dict(out)


def test_snapshots_collapse_to_the_longest(spark):
    turns = ["hi", "hello", "how", "fine", "bye"]
    rows = [(10 * n, t, "ua"[t % 2], turns[t]) for n in range(1, 6) for t in range(n)]
    rows += [(7, t, "ua"[t % 2], turns[t]) for t in range(5)]
    rows += [(90, 0, "u", "hi"), (90, 1, "a", "other")]
    got = formatted(spark, rows)
    assert got == brute(rows) and set(got) == {7, 90}


def test_long_conversations_in_blocks(spark):
    rows = [(1, t, "u", f"t{t}") for t in range(50)] + [(2, t, "u", f"t{t}") for t in range(33)] + [(3, t, "u", f"t{t + (t > 40)}") for t in range(50)]
    for block in (7, 16, 1024):
        assert formatted(spark, rows, block) == brute(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(1, 0, None, "x"), (2, 0, "unknown", "x"), (2, 1, "u", None), (3, 0, "unknown", "x"), (None, 0, "u", "q"), (4, 0, "u", "q"), (4, 1, "u", ""),
            (5, 0, "u", ""), (6, 0, "u", None), (7, None, "s", "first"), (7, 0, "u", "then"), (7, 0, "u", "then"), (8, None, "s", "first")]
    assert formatted(spark, rows) == brute(rows)


def test_conversations_against_sql_and_brute_force(spark, sf_dir):
    assert compare(C.query(spark, sf_dir), connect(sf_dir), C.SQL)[1] == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert formatted(spark, rows) == brute(rows)


def test_empty_table_clashing_names_and_no_python(spark):
    assert formatted(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "u", "x", 3, "c")], SCHEMA + ", block int, conv string")
    out = C.format_chats(df)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, "<|u|>\nx\n<|end|>\n")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_a_fixed_number_of_turns_whatever_their_numbers(spark):
    rows = [(None, 5, "u", f"t{i:03d}") for i in range(90)] + [(None, 5, "u", "t000")] * 40 + [(2, None, "u", f"t{i}") for i in range(30)]
    rows += [(3, 10_000 * i, "a", f"s{i}") for i in range(25)]
    got = C.format_chats(spark.createDataFrame(rows, SCHEMA), block_turns=8).collect()
    assert max(r.n_turns for r in got) == 8
    turns = defaultdict(int)
    for r in got:
        turns[r.conv_id] += r.n_turns
    assert turns == {None: 90, 2: 30, 3: 25}
    chats = formatted(spark, rows, 8)
    assert chats[3] == brute(rows)[3]
    assert all(chats[c] == formatted(spark, rows, 1024)[c] for c in chats)
    # turns with one number have no order but that of their hashes
    assert {x.strip() for x in chats[None].split("<|end|>")} == {x.strip() for x in brute(rows)[None].split("<|end|>")}
