from duelframe.llm import preferences
from duelframe.session import tune

TURNS = "pair_id long, is_chosen boolean, turn int, role string, text string, prompt string"


def formatted(spark, rows):
    table = tune(spark).createDataFrame([(*r, "x") for r in rows], TURNS)
    return {r.pair_id: r for r in preferences.format_preferences(table).collect()}


def line(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_prefix_is_rendered_once(spark):
    both = [(0, "system", "s"), (1, "user", "ü?")]
    rows = [(1, side, *t) for side in (True, False) for t in both]
    rows += [(1, True, 2, "assistant", "good"), (1, True, 3, "user", "more"), (1, True, 4, "assistant", "yes"), (1, False, 2, "assistant", "bad")]
    r = formatted(spark, rows)[1]
    assert (r.n_prompt_turns, r.tied) == (2, False) and r.prompt == line("system", "s") + line("user", "ü?")
    assert r.chosen == line("assistant", "good") + line("user", "more") + line("assistant", "yes") and r.rejected == line("assistant", "bad")
    assert [r.chosen[s.start:s.end] for s in r.chosen_mask] == ["good", "yes"] and [r.rejected[s.start:s.end] for s in r.rejected_mask] == ["bad"]


def test_defined_results(spark):
    rows = [(1, True, 0, "user", "a"), (1, False, 0, "user", "a")]                                   # identical
    rows += [(2, True, 0, "user", "a")]                                                              # one side
    rows += [(3, True, 0, None, None), (3, False, 0, None, None), (3, False, 1, "assistant", None)]  # nulls, one side a prefix
    rows += [(4, True, 0, "user", "a"), (4, True, 0, "user", "a"), (4, False, 0, "user", "a")]       # a repeated turn
    rows += [(None, True, 0, "user", "a"), (5, None, 0, "user", "a")]
    rows += [(6, side, 0, "assistant", text * 100_000) for side, text in ((True, "p"), (False, "q"))]
    found = formatted(spark, rows)
    assert set(found) == {1, 2, 3, 4, 6}
    assert (found[1].tied, found[1].chosen, found[1].rejected, found[1].chosen_mask) == (True, "", "", [])
    assert (found[2].tied, found[2].prompt, found[2].chosen, found[2].rejected, found[2].rejected_mask) == (False, "", line("user", "a"), None, None)
    assert (found[3].n_prompt_turns, found[3].prompt, found[3].chosen) == (1, line("unknown", ""), "")
    assert found[3].rejected == line("assistant", "") and [(s.start, s.end) for s in found[3].rejected_mask] == [(22, 22)]
    assert (found[4].n_prompt_turns, found[4].chosen, found[4].rejected, found[4].tied) == (1, line("user", "a"), "", False)
    assert found[6].n_prompt_turns == 0 and found[6].chosen_mask[0].end == 100_022


def test_empty(spark):
    assert formatted(spark, []) == {}


def test_pairs_from_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "r"), (2, 1, "assistant", "b"), (4, 0, "user", "z"), (None, 0, "user", "n")]
    table = tune(spark).createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {r.pair_id: r for r in preferences.format_preferences(preferences.pairs_from_conversations(table)).collect()}
    assert set(found) == {1, 2, 4} and found[1].rejected == line("assistant", "b") and found[1].prompt == line("user", "q")
    assert found[2].rejected is None and found[4].rejected is None
