from __future__ import annotations

import pytest

from lodestone.operators import chunking as K


def plain_windows(text, most, overlap):
    """Windows line by line, as they are described."""
    lines, out, start = text.splitlines(), [], 0
    while start < len(lines):
        n, size = start, 0
        while n < len(lines) and size < most:
            size += len(lines[n]) + 1
            n += 1
        out.append((start + 1, max(start + 1, n), "\n".join(lines[start:n])))
        start = max(start + 1, n - overlap)
    return out


@pytest.mark.parametrize("most", [1, 10, 25, 7000])
@pytest.mark.parametrize("overlap", [0, 1, 3])
@pytest.mark.parametrize("text", ["", "a\nb\nc\nd\n", "\n\n\n", "one long line " * 20, "\r\n".join(f"line {i} " + "x" * (i * 7 % 30) for i in range(60))])
def test_windows(text, most, overlap):
    assert [(c["line_start"], c["line_end"], c["text"]) for c in K.windows(text, "file", most, overlap)] == plain_windows(text, most, overlap)


def test_the_end_of_a_text_is_covered_again():
    assert len(K.windows("a\nb\nc\nd\ne", "file")) == 4
    assert len(K.windows("a", "file")) == 1


def test_markdown():
    got = K.markdown("intro\n# Title\ntext\n\n## Section\nmore")
    assert [(c["symbol_name"], c["line_start"], c["line_end"]) for c in got] == [("Title", 2, 4), ("Section", 5, 6)]
    assert got[0]["symbol_kind"] == "section"
    assert K.markdown("#\nx")[0]["symbol_name"] is None
    assert K.markdown("plain")[0]["kind"] == "documentation_section"


SOURCE = '''import os
from a.b import c

@app.get("/x")
class Service(Base):
    """Doc."""

    async def run(self):
        helper.go(os.path.join("a"))

        def inner():
            pass

    class Nested:
        def deep(self): pass

def free():
    return Service().run()
'''


def test_python():
    got = {c["symbol_name"]: c for c in K.python(SOURCE)}
    assert list(got) == ["Service", "run", "Nested", "deep", "free"]
    assert got["Service"]["kind"] == "class_definition" and got["Service"]["decorators"] == ["app.get"] and got["Service"]["docstring"] == "Doc." and got["Service"]["calls"] is None
    assert got["run"]["kind"] == "method_definition" and got["run"]["parent_symbol"] == "Service" and got["run"]["signature"] == "async def run"
    assert got["run"]["calls"] == ["helper.go", "os.path.join"]
    assert got["deep"]["parent_symbol"] == "Service.Nested"
    assert got["free"]["kind"] == "function_definition" and got["free"]["imports"] == ["a.b.c", "os"]
    assert "Service.run" in got["free"]["calls"]
    assert [c["kind"] for c in K.python("def broken(:")] == ["file"]


CODE = """import { x } from 'lib/x'
using System.Text

@Get('/payments/:id')
export async function getPayment(id) {
  if (id) { return load(id); }
}

public class Foo extends Bar {
  int count = 0
}
interface Thing {
}
let total = 5;
function testLogin() {
  expect(1)
}
"""


def test_declarations():
    got = {c["symbol_name"]: c for c in K.declarations(CODE)}
    assert got["getPayment"]["line_start"] == 5 and got["getPayment"]["line_end"] == 7
    assert got["getPayment"]["decorators"] == ["@Get('/payments/:id')"] and got["getPayment"]["calls"] == ["getPayment", "load"]
    assert got["Thing"]["kind"] == "class_definition"
    assert got["testLogin"]["kind"] == "test_case"
    assert "total" in got and got["total"]["imports"] == ["System.Text", "lib/x"]
    assert K.declarations("just some prose.") == []


def test_declaring_lines_are_found_in_linear_time():
    import time

    began = time.time()
    K.declarations(("word " * 4000 + "\n") * 20)
    assert time.time() - began < 5


def test_dispatch():
    assert K.chunk_file("python", "source_code", "x = 1")[0]["kind"] == "file"
    assert K.chunk_file("yaml", "config", "a: 1")[0]["kind"] == "config_block"
    assert K.chunk_file("java", "source_code", "prose only.")[0]["kind"] == "file"
    assert K.chunk_file("java", "source_code", "") == []
    K.GRAMMARS["toy"] = lambda text: [K.raw("file", 1, 1, "own")]
    try:
        assert K.chunk_file("toy", "source_code", "x")[0]["text"] == "own"
    finally:
        del K.GRAMMARS["toy"]


def test_large_chunks_lose_their_symbol():
    big = K.raw("function_definition", 5, 900, "\n".join("y" * 99 for _ in range(100)), symbol_name="f")
    got = K.split_large([big])
    assert len(got) > 1 and got[0]["line_start"] == 1 and got[0]["symbol_name"] is None


def test_what_no_parser_stack_holds_becomes_windows(monkeypatch):
    """such a text ended the run with a MemoryError."""
    deep = "-" * 100_000 + "1"
    assert [(c["kind"], c["text"]) for c in K.chunk_file("python", "source_code", deep)] == [("file", deep)]
    pd = pytest.importorskip("pandas")
    files = pd.DataFrame({"path": ["a", "b"], "language": "text", "file_class": "config", "content": ["x\ny\n", deep]})
    whole = pd.concat(K.chunk_partitions(iter([files]), ["path"]))
    monkeypatch.setattr(K, "FRAME_CHARS", 2)
    parts = list(K.chunk_partitions(iter([files]), ["path"]))
    assert len(parts) > 1 and pd.concat(parts).to_dict("records") == whole.to_dict("records")
