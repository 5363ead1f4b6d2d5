from shardflow.llm import preference

SCHEMA = "conv_id long, turn long, role string, text string, c string, t string, k int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "c", "t", 1) for r in rows], SCHEMA)


def test_prompt_completions_and_masks(spark):
    rows = [
        (1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "yes"), (1, 3, "user", "ok"), (1, 4, "assistant", "bye"),
        (2, 0, "system", "S"), (2, 1, "user", "Q"), (2, 2, "assistant", "no"),
        (3, 0, "user", "Q"), (4, 0, "user", "Q"), (4, 1, None, None), (4, 1, None, None),
    ]
    pairs = spark.createDataFrame([(7, 1, 2), (8, 3, 4), (9, 3, 3), (10, None, 2), (11, 99, None)], "pair_id long, chosen long, rejected long")
    got = {r.pair_id: r for r in preference.format_preferences(pairs, turns(spark, rows)).collect()}
    start, end = "<|im_start|>", "<|im_end|>\n"
    first = got[7]
    assert first.prompt_turns == 2 and first.prompt == f"{start}system\nS{end}{start}user\nQ{end}"
    assert first.chosen_completion == f"{start}assistant\nyes{end}{start}user\nok{end}{start}assistant\nbye{end}"
    assert [first.chosen_completion[s.start : s.end] for s in first.chosen_mask] == ["yes", "bye"]
    assert [first.rejected_completion[s.start : s.end] for s in first.rejected_mask] == ["no"]
    assert (got[8].prompt_turns, got[8].chosen_completion, got[8].rejected_completion) == (1, "", f"{start}\n{end}" * 2)
    assert (got[9].prompt_turns, got[9].chosen_completion, got[9].rejected_completion) == (1, "", "")
    assert (got[10].prompt_turns, got[10].prompt, got[10].chosen_completion) == (0, "", "")
    assert (got[11].prompt, got[11].chosen_mask, got[11].rejected_mask) == ("", [], [])


def test_pairs_of_one_opening(spark):
    rows = [(k, 0, "user", "same") for k in range(9)] + [(20, None, None, "x"), (None, 0, "user", "same")]
    pairs = [tuple(r) for r in preference.opening_pairs(turns(spark, rows)).collect()]
    seen = [x for _, a, b in pairs for x in (a, b) if x is not None]
    assert sorted(seen) == [*range(9), 20] and sorted(b is None for *_, b in pairs) == [False] * 4 + [True] * 2
    assert all(p == a for p, a, _ in pairs)


def test_empty_tables(spark):
    nothing = turns(spark, [])
    pairs = preference.opening_pairs(nothing)
    assert pairs.collect() == [] and preference.format_preferences(pairs, nothing).collect() == []
