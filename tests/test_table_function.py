"""The table function tries one pattern a line."""

import re

from doclake.jobs import convert


class Registered:
    """Takes what a session would register."""

    def __init__(self):
        self.udtf = self

    def register(self, name, made):
        self.lines = made.func


def test_a_line_is_matched_once(monkeypatch):
    session = Registered()
    convert.register_markdown_blocks(session)
    monkeypatch.setattr(re, "match", None)
    told = "# a\n\n 　\x1c\n#no\n```x\n---\r\n** *\n | a |\n- a\n-\n٣) y\n12. \nend"
    got = [(ln, kind) for ln, kind, _ in session.lines().eval(told)]
    assert got == [(0, "heading"), (3, "text"), (4, "fence"), (5, "hrule"), (6, "text"), (7, "table"), (8, "bullet"), (9, "text"), (10, "ordered"), (11, "text"), (12, "text")]
    assert list(session.lines().eval(None)) == [] and list(session.lines().eval("")) == []
