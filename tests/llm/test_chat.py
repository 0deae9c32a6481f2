import hashlib

import pytest

from switchyard.llm import chat as C
from switchyard.llm.chat_template import TemplateError, compile_template, folded, parse

SCHEMA = "conv_id long, turn long, role string, text string, part long, spans string"
ROWS = [
    (1, 0, "user", "hi", 1, "x"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n\\<|", 1, "x"),
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n\\<|", 1, "x"), (1, None, "system", None, 1, "x"),
    (2, 0, None, "", None, None), (2, 1, "odd\nrole<|\\", "a\\n\\\\b<", None, None), (None, 5, "assistant", "x" * 300000, 1, "x"),
    (3, 2, "assistant", "é" * 10, 1, "x"), (3, 2, "assistant", "a", 1, "x"),
]


def want(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[k] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_round_trip_of_odd_turns(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    formatted = C.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(formatted).collect()}
    assert got == want(ROWS)
    lengths = {r.conv_id: r.formatted_chars for r in C.read_back(formatted).collect()}
    assert sum(len(r.text) for r in formatted.collect()) == sum(lengths.values())


def test_small_parts_give_the_same():
    reader, whole = C.Reader(), C.Reader()
    render = compile_template(C.TEMPLATE, C.FILTERS)
    turns = [{"role": r or "", "text": t or ""} for _, _, r, t, _, _ in ROWS]
    text, spans = "", []
    for piece, marked in render({"messages": turns}):
        reader.feed(piece, [{"start": 0, "end": len(piece)}] if marked else [])
        if marked:
            spans.append({"start": len(text), "end": len(text) + len(piece)})
        text += piece
    whole.feed(text, spans)
    assert (reader.turns, reader.turn_hash.digest(), reader.loss_hash.digest()) == (whole.turns, whole.turn_hash.digest(), whole.loss_hash.digest())


def test_empty_table(spark):
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\<|", "<\\|", "\\\\<\\|<|x|>", "<", "|>", "a\\nb\n"])
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.unheader(C.header(text)) == text and "\n" not in C.header(text)


def render(source, **env):
    return "".join(t for t, _ in compile_template(source, {"up": str.upper})(env))


def test_language():
    assert render("{{ 'a' + 'b' | up }}{{ x.y }}{{ x['z'] }}{{ none }}", x={"y": 1, "z": "q"}) == "aB1q"
    assert render("{% if a == 1 and not b %}1{% elif b %}2{% else %}3{% endif %}", a=1, b=False) == "1"
    assert render("{% if a != 1 or b %}1{% else %}3{% endif %}", a=1, b="") == "3"
    assert render("{% for i in xs %}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[1, 2, 3]) == "1,2,3"
    assert list(compile_template("a{% generation %}b{% endgeneration %}c")({})) == [("a", False), ("b", True), ("c", False)]


def test_constants_are_folded():
    tree = folded(parse("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}e", {}))
    assert tree == [("text", "abcde")]


def test_sandbox_and_errors():
    assert render("{{ x.__class__ }}|{{ x.keys }}", x={"a": 1}) == "|"
    assert render("{{ x.real }}", x=5) == ""
    for bad in ("{{ f() }}", "{{ a | nofilter }}", "{% if a %}", "{% endfor %}", "{{ a[b] }}", "{% for 1 in a %}{% endfor %}", "{{ import os }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
