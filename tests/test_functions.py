import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from foldline.functions import jsonpatch as jp
from foldline.functions import preview as pv
from foldline.functions.shell import ReadTarget, read_targets, split


@pytest.mark.parametrize("line", ['{"uuid":"b","z":1.50,"n":1e5,"a":[true,null,"é\\n"]}', '{"b":1,"a":{"d":-0.0}}', "[]"])
def test_json_keeps_order_and_numbers(line):
    assert jp.dumps(jp.loads(line)) == line


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_json_round_trip(value):
    assert json.loads(jp.dumps(jp.loads(json.dumps(value)))) == value


def test_json_reads_are_strict():
    v = jp.loads('{"a":1,"b":1.0,"c":"1","d":null,"e":99999999999}')
    assert [jp.integer(v, k) for k in "abcde"] == [1, None, None, None, None]
    assert [jp.text(v, k) for k in "abcd"] == [None, None, "1", None]
    with pytest.raises(ValueError):
        jp.loads('{"a":NaN}')


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("cat a.txt b.txt", [("a.txt", 1, None), ("b.txt", 1, None)]),
        ("sed -n '10,20p;30p' src/x.py", [("src/x.py", 10, 20), ("src/x.py", 30, 30)]),
        ("/usr/bin/head -n 40 'my file'", [("my file", 1, 40)]),
        ("head -5 a; echo sep; cat b", [("a", 1, 5), ("b", 1, None)]),
        ("tail -n 5 a", []), ("cat -n a", []), ("cat a | grep x", []), ("cat a > b", []), ("cat $(ls)", []), ("rm a; cat b", []), ("cat 'a", []), ("echo $HOME; cat a", []), ("sed -n '20,10p' a", []), ("", []), (None, []),
    ],
)
def test_read_targets(command, want):
    assert [tuple(t) for t in read_targets(command)] == want


def test_split_quotes():
    assert split('a"b c"\'d\'\\ e;f') == [("ab cd e", False), (";", True), ("f", False)]
    assert split('"a\\"b\\x"') == [('a"b\\x', False)]
    assert split("a\\") is None


def test_covers():
    assert ReadTarget("a", 1, None).covers(ReadTarget("a", 5, 9))
    assert not ReadTarget("a", 1, 9).covers(ReadTarget("a", 5, None))
    assert not ReadTarget("a", 1, 9).covers(ReadTarget("b", 5, 9))


@pytest.mark.parametrize(
    ("tool", "arg", "text", "want"),
    [
        ("Bash", "pytest -q", "..\nFAILED t::a\n=== 1 failed, 2 passed in 3s ===", "RESULT: 1 failed, 2 passed in 3s | first failures: t::a"),
        ("Bash", "ls", "Traceback (most recent call last)\nboom", "CONTAINS 'Traceback (most recent call last)' :: Traceback (most recent call last)"),
        ("Edit", "a.py", "ok", "applied to a.py"),
        ("Read", "a.py", "1\tdef f():\n2\t  {\n3\tx", "3 lines :: def f(): / x"),
        ("Bash", "x", '[{"b":1,"a":2}]', "JSON array, 1 item(s) of objects with keys [a, b]"),
        ("Bash", "x", " \n", "(no output)"),
        ("Bash", "git status", "M a\nM b", "2 status line(s) :: M a / M b"),
        ("Bash", "x", "== one ==\nA\n== two ==\n\nB", "2 sections | one: A | two: B"),
        ("Bash", "x | tail -3", "a\nb\nc\nd", "tail :: b / c / d"),
        ("Grep", "x", "a\n\nb\nc", "a / b"),
    ],
)
def test_preview(tool, arg, text, want):
    assert pv.preview(tool, arg, text) == want
    assert pv.preview(tool, arg, text, True) == "[ERROR] " + want


def test_shorter_forms():
    assert pv.minify('{\n   "b" : 1.50,\n      "a" : [ 1, 2 ]\n}') == '{"b":1.50,"a":[1,2]}'
    diff = "diff --git a b\n--- a\n+++ b\n@@ -1,5 +1,5 @@\n" + " same line that is long\n" * 9 + "-x\n+y\n"
    assert "[...9 unchanged lines...]" in pv.minify(diff)
    assert pv.minify("plain words") == "plain words"
