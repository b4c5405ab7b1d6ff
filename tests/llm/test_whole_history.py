"""Chat spans of templates that look at the whole conversation."""

import pytest

from quorate.llm import chat


def templates():
    """Made here, so that they travel to workers by value."""

    def numbered(turns):
        assert all((r == "user") == (i % 2 == 0) for i, (r, _) in enumerate(turns)), "roles alternate"
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    def late_rewrite(turns):
        return "".join("-;" if i == 1 and len(turns) > 50 else f"{t};" for i, (_, t) in enumerate(turns))

    return numbered, late_rewrite


def test_long_conversations_are_rendered_whole(spark):
    numbered, late_rewrite = templates()
    turns = [(1, k, "assistant" if k % 2 else "user", f"text{k}") for k in range(80)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(frame, numbered).collect(), key=lambda r: r.position)
    assert [r.span for r in rows] == [f"{k}:text{k};" for k in range(80)]
    assert [r.start for r in rows] == [sum(len(x.span) for x in rows[:k]) for k in range(80)]
    assert all(r.span[r.text_start : r.text_end] == f"text{r.position}" and not r.rewritten for r in rows)
    rows = chat.format_turns(frame, late_rewrite).collect()
    assert {r.position for r in rows if r.rewritten} == {50}


def test_spans_equal_whole_renderings_at_200_turns(spark):
    turns = [(r, f"<|end|> {k} [INST]" * (k % 3)) for k, r in enumerate(["user", "assistant"] * 100)]
    frame = spark.createDataFrame([(1, k, *turn) for k, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    want = [chat.marked_turns(turns[: k + 1])[len(chat.marked_turns(turns[:k])) :] for k in range(200)]
    for window in (None, 32):
        rows = sorted(chat.format_turns(frame, window=window).collect(), key=lambda r: r.position)
        assert [r.span for r in rows] == want and not any(r.rewritten for r in rows)
        assert [r.start for r in rows] == [len(chat.marked_turns(turns[:k])) for k in range(200)]


def test_window_refuses_templates_that_count_turns():
    renderer = chat.Renderer(lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns)), window=4)
    with pytest.raises(ValueError, match="earlier turns"):
        for k in range(8):
            renderer.add("assistant" if k % 2 else "user", f"text{k}")


def test_no_window_unless_asked_for():
    assert chat.Renderer(chat.marked_turns).window is None
