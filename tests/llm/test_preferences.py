from chainlog.llm import preferences as p

TURNS = "pair_id long, turn long, role string, text string"


def render(role, text):
    return f"<|{role or ''}|>\n{text or ''}<|end|>\n"


def run(spark, chosen, rejected):
    out = p.format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()
    return {(r["pair_id"], r["section"], r["part"]): r for r in out}


def test_longest_common_prefix_becomes_the_prompt(spark):
    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more")]
    got = run(spark, [*talk, (1, 3, "assistant", "good"), (1, 4, "user", "thanks")], [*talk, (1, 3, "assistant", "bad")])
    assert set(got) == {(1, "prompt", 0), (1, "chosen", 0), (1, "rejected", 0)}
    prompt, chosen = got[1, "prompt", 0], got[1, "chosen", 0]
    assert prompt["text"] == "".join(render(r, t) for _, _, r, t in talk) and prompt["targets"] == [] and prompt["n_turns"] == 3
    assert chosen["text"] == render("assistant", "good") + render("user", "thanks")
    assert [chosen["text"][s["start"] : s["end"]] for s in chosen["targets"]] == ["good<|end|>\n"]


def test_equal_sides_and_missing_sides(spark):
    same = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    got = run(spark, [*same, (2, 0, "user", "only")], same)
    assert set(got) == {(1, "prompt", 0), (2, "chosen", 0)} and got[1, "prompt", 0]["n_turns"] == 2


def test_nulls_ties_and_repeats(spark):
    chosen = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "last"), (1, 1, "user", "b"), (1, 1, "user", "a"), (None, 0, "user", "x")]
    got = run(spark, chosen, [(1, 0, None, None)])
    assert got[1, "prompt", 0]["text"] == render(None, None)
    assert got[1, "chosen", 0]["text"] == render("user", "a") + render("user", "b")
    assert got[1, "chosen", None]["text"] == render("assistant", "last") and got[1, "chosen", None]["first_turn"] is None


def test_a_long_conversation_is_many_rows(spark):
    talk = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)]
    got = run(spark, talk, talk[:500])
    assert sum(r["n_turns"] for r in got.values()) == 1000 and max(r["n_turns"] for r in got.values()) == p.PART_TURNS
    parts = [got[k]["text"] for k in sorted((k for k in got if k[1] == "chosen"), key=lambda k: k[2])]
    assert "".join(parts) == "".join(render(r, t) for _, i, r, t in talk if i >= 500)


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (3, 0, "user", "q3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in p.with_other_reply(df).collect()}
    assert got == {(0, 0): "q0", (0, 1): "a1", (1, 0): "q1", (1, 1): "a0", (2, 0): "q2", (3, 0): "q3"}


def test_rows_without_a_pair_stay(spark):
    """A third of all rows without an id: each is a row of one pair under null, with its repeats."""
    lost = [(None, i % 3, "user" if i % 3 == 0 else "assistant", f"t{i % 7}") for i in range(300)] + [(None, None, "assistant", "last")] * 2
    talk = [(i, t, "user", "q") for i in range(200) for t in range(3)]
    schema = spark.createDataFrame([], TURNS).schema
    other = [r for r in lost if r[1] != 1] + [(None, 1, "assistant", "other")]
    out = [r for r in p.format_preferences(spark.createDataFrame(lost + talk, schema), spark.createDataFrame(other + talk, schema)).collect()]
    assert sum(r["n_turns"] for r in out if r["pair_id"] is not None) == len(talk)
    got = sorted((r["section"], str(r["first_turn"]), str(r["part"]), r["text"], [tuple(x) for x in r["targets"]], r["n_turns"]) for r in out if r["pair_id"] is None)
    def row(section, turn, role, text):
        whole = render(role, text)
        spans = [(len(role) + 5, len(whole))] if section != "prompt" and role == "assistant" else []
        return section, str(turn), "None" if turn is None else "0", whole, spans, 1
    want = [row("prompt" if t == 0 else "chosen", t, r, x) for _, t, r, x in lost] + [row("rejected", t, r, x) for _, t, r, x in other if t != 0]
    assert got == sorted(want)


def test_repeats_without_a_turn_number_count(spark):
    rows = [(1, None, "user", "hi"), (1, None, "user", "hi"), (1, None, "assistant", "a")]
    got = run(spark, rows, rows[:1])
    assert got[1, "chosen", None]["text"] == render("assistant", "a") + render("user", "hi") * 2 and got[1, "rejected", None]["n_turns"] == 1


def test_swapped_replies_keep_rows_without_a_conversation(spark):
    rows = [(None, 0, "user", "q"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (0, 0, "user", "q0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, p.with_other_reply(df).collect()), key=str) == sorted(rows, key=str)
