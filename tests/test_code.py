from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import chunking, code

SCRIPT = """// a module
import a from 'a'
import { b } from "b"

export const limit = { n: 1 }

/* helper { */
export async function load(x) {
  const s = "}"
  return `${x} {`
}

@decorated
class Store extends Base {
  get(k) { return this.m[k] }
}

export const add = (x, y) => {
  return x + y
}
"""
GO = 'package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) F() string {\n\treturn `}`\n}\n'
RUST = "use std::fmt;\n\n#[derive(Debug)]\npub struct S<'a> {\n    x: &'a str,\n}\n\nimpl<'a> S<'a> {\n    pub fn f(&self) -> char { '{' }\n}\n\npub async fn run() {}\n\nenum E { A }\n"


def named(text, lang):
    found, imports = code.definitions(text, lang)
    return [d.name for d in found], imports


def test_definitions_of_each_language():
    assert named(SCRIPT, "typescript") == (["load", "Store", "add"], ["import a from 'a'", 'import { b } from "b"'])
    assert named(GO, "go") == (["T", "F"], ['import (\n\t"fmt"\n)'])
    assert named(RUST, "rust") == (["S", "S", "run", "E"], ["use std::fmt;"])
    assert named("import os\n@d\ndef f():\n    pass\nclass A:\n    x = 1\n", "python") == (["f", "A"], ["import os"])
    assert code.definitions("def (", "python") == ([], []) and code.language("A/B.TSX") == "typescript" and code.language("x.md") is None


def test_attributes_and_decorators_stay_with_what_they_mark():
    found, _ = code.definitions(RUST, "rust")
    assert RUST[found[0].start :].startswith("#[derive(Debug)]") and RUST[found[0].start : found[0].end].endswith("}")
    found, _ = code.definitions(SCRIPT, "javascript")
    assert SCRIPT[found[1].start : found[1].end].startswith("@decorated\nclass Store") and SCRIPT[found[0].start : found[0].end].endswith("{`\n}")


def test_chunks_have_context_and_the_end_of_the_one_before():
    got = code.chunks(SCRIPT, "m.ts")
    assert len(got) == 3 and all("import a from 'a'" in c for c in got)
    tail = got[0][-code.LEAST_OVERLAP :]
    assert f"{tail}\n@decorated" in got[1]
    assert code.chunks("x = 1", "a.py") == ["x = 1"] and code.chunks("  ", "a.py") == [] and code.chunks("plain", "a.zig") == ["plain"]


def test_large_definitions_are_cut_between_statements():
    body = "\n".join(f"    step_{k} = call({k}, [\n        {k},\n    ])" for k in range(60))
    text = f"import os\n\ndef f():\n{body}\n\ndef g():\n    pass\n"
    (f, g), _ = code.definitions(text, "python")
    pieces = code.cut_large(text, f)
    assert len(pieces) > 2 and all(code.size(p) <= code.MOST for p in pieces)
    assert all(p.lstrip().startswith(("def f", "step_")) and p.rstrip().endswith(("])", ":")) for p in pieces)
    assert "\n".join(pieces) == text[f.start : f.end] and code.cut_large(text, g) == ["def g():\n    pass"]
    got = code.chunks(text, "a.py")
    assert len(got) == len(pieces) + 1 and f"# ... split 2/{len(pieces)} of f ..." in got[1]
    lines = "\n".join(f"  const v{k} = make({{ k: {k} }});" for k in range(60))
    script = f"function f() {{\n{lines}\n}}\n"
    (d,), _ = code.definitions(script, "javascript")
    cut = code.cut_large(script, d)
    assert len(cut) > 2 and "\n".join(cut) == script.strip() and all(p.rstrip().endswith((";", "{", "}")) for p in cut)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["function f() {\n", "}\n", "  x = 1\n", "class A {\n", "'", '"', "`", "/*", "*/", "// x\n", "import q\n", "(", ")", "fn g() {\n", "\n", "#[a]\n"]), max_size=25), st.sampled_from(["a.js", "a.go", "a.rs", "a.py"]))
def test_any_text_is_cut_without_failing(parts, path):
    text = "".join(parts)
    found, _ = code.definitions(text, code.language(path))
    assert all(0 <= d.start < d.end <= len(text) for d in found) and all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    assert bool(code.chunks(text, path)) == bool(text.strip())


def test_pieces_of_the_prose_chunker():
    assert chunking.by_words("aa bb " + "c" * 25 + " d", 20) == ["aa bb", "c" * 10 + "...", "..." + "c" * 10 + "...", "..." + "c" * 5, "d"]
    assert chunking.by_sentences("One is here. Two is here. Three is here. Ok.", 26, 8) == ["One is here. Two is here.", "Three is here. Ok."]
    assert chunking.with_overlap(["first words of it", "second"], 100, 0.1) == ["first words of it", "...of it second"]
    assert chunking.sub_chunks("x" * 10, 20) == ["x" * 10] and len(chunking.sub_chunks("\n".join(["line " * 20] * 100), 1024)) > 3


def test_code_between_and_after_definitions_is_kept():
    got = code.chunks("import os\n\ndef f():\n    return 1\n\nX = 5\n\ndef g():\n    return 2\n\nif __name__ == '__main__':\n    f()\n", "a.py")
    assert len(got) == 3 and got[2] == "import os\n\nX = 5\nif __name__ == '__main__':\n    f()"
    assert "const late" in code.chunks("function f() {\n  return 1\n}\nlet x = 1\nconst late = 2\n", "a.js")[-1]


def test_texts_that_are_short_throughout_are_kept():
    assert chunking.by_sentences("Ok.", 400, 80) == ["Ok."] and chunking.by_sentences("", 400, 80) == []
    assert chunking.by_sentences("Ok. " + "A long sentence of words. " * 9, 60, 20)[0].startswith("Ok. A long")
    assert chunking.by_words("", 10) == [] and chunking.by_words("a b", 3) == ["a b"] and chunking.by_words("a bc", 3) == ["a", "bc"]
