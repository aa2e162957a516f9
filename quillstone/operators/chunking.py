"""Files to chunks: definitions where a parser knows the language, line windows elsewhere.

Exact by design: line windows, coalescing, generated-file and NUL rules.  Definitions come from Python's own
parser for Python, and from a brace or indentation scanner for other languages, which is a heuristic."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import constants as K

Span = tuple[int, int, str | None]  # half-open lines from 0, symbol
CUT_LETTERS = 4 << 20  # letters of chunks that are handed on at once


def split_lines(content: str) -> list[str]:
    """Lines without their ends; a trailing newline begins no line."""
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def windows(lines: list[str], first: int = 0, last: int | None = None) -> list[Span]:
    """Overlapping windows of lines first..last; a cut moves back to a blank line close by; blank windows go."""
    end = len(lines) if last is None else last
    out: list[Span] = []
    start = first
    while start < end:
        stop = min(start + K.WINDOW, end)
        if stop < end:
            blank = next((i for i in range(stop - 1, max(stop - K.SNAP, start) - 1, -1) if not lines[i].strip()), None)
            if blank is not None and blank > start:
                stop = blank
        if any(x.strip() for x in lines[start:stop]):
            out.append((start, stop, None))
        if stop >= end:
            break
        start = max(stop - K.OVERLAP, start + 1)
    return out


def shared_symbol(a: str | None, b: str | None) -> str | None:
    """What two symbol paths begin with; one without a symbol takes the other's."""
    if a is None or b is None:
        return a or b
    common = []
    for x, y in zip(a.split(" > "), b.split(" > ")):
        if x != y:
            break
        common.append(x)
    return " > ".join(common) or None


def coalesce(spans: list[Span]) -> list[Span]:
    """Short spans join the next one, a short last one the one before."""
    out: list[Span] = []
    held: Span | None = None
    for span in spans:
        if held is not None:
            span = (held[0], span[1], shared_symbol(held[2], span[2]))
        held = span if span[1] - span[0] < K.MIN_LINES else None
        if held is None:
            out.append(span)
    if held is not None:
        if out:
            before = out.pop()
            held = (before[0], held[1], shared_symbol(before[2], held[2]))
        out.append(held)
    return out


class Definition:
    def __init__(self, start: int, end: int, name: str, children: list[Definition]):
        self.start, self.end, self.name, self.children = start, end, name, children


def python_definitions(content: str) -> list[Definition] | None:
    def of(node) -> list[Definition]:
        found = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                found.append(Definition(first - 1, child.end_lineno, child.name, of(child)))
            else:  # definitions within conditions, loops and the like
                found.extend(of(child))
        return found

    try:
        return of(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError):
        return None


_NAMED = re.compile(
    r"^\s*(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|static|final|abstract|async|unsafe|override|open|data|sealed|inline|extern|virtual|const)\s+)*"
    r"(?:(?:fn|func|fun|function|class|struct|enum|trait|interface|impl|mod|module|namespace|object|union|def|type)\b\s*(?:<[^>]*>\s*)?([A-Za-z_$][\w$:]*)|([A-Za-z_][\w<>:*&\[\], ]*?[\s*&]+)([A-Za-z_~][\w:]*)\s*\([^;{}]*\)?\s*[^;={}]*\{)"
)


def brace_definitions(content: str) -> list[Definition]:
    """Named blocks by counting braces outside strings and comments."""
    lines = split_lines(content)
    opened: list[tuple[int, str | None, list[Definition]]] = []
    top: list[Definition] = []
    for i, line in enumerate(lines):
        code = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'|//.*$|#.*$', "", line)
        match = _NAMED.match(code)
        name = (match.group(1) or match.group(3)) if match else None
        if name in ("if", "for", "while", "switch", "catch", "return", "else"):
            name = None
        for c in code:
            if c == "{":
                opened.append((i, name, []))
                name = None
            elif c == "}" and opened:
                start, own, inside = opened.pop()
                into = opened[-1][2] if opened else top
                into.extend([Definition(start, i + 1, own, inside)] if own else inside)
    return top


_TRIVIA = re.compile(r"^\s*(//|#|/\*|\*|@|\*/|--)")


def definition_spans(lines: list[str], definitions: list[Definition]) -> list[Span]:
    """Definitions with the comments above them; long ones are descended into; gaps, and long ones
    without definitions in them, become windows without symbol."""
    out: list[Span] = []

    def walk(own: list[Definition], low: int, high: int, path: str) -> None:
        at = low
        for d in sorted(own, key=lambda d: d.start):
            start = d.start
            while start > at and _TRIVIA.match(lines[start - 1]):
                start -= 1
            symbol = f"{path} > {d.name}" if path else d.name
            gap(at, start)
            if d.end - start <= K.MAX_DEF_LINES:
                out.append((start, d.end, symbol))
            elif d.children:
                walk(d.children, start, d.end, symbol)
            else:
                gap(start, d.end)
            at = max(at, d.end)
        gap(at, high)

    def gap(low: int, high: int) -> None:
        out.extend(windows(lines, low, high))

    walk(definitions, 0, len(lines), "")
    return out


Parser = Callable[[str, str], "list[Definition] | None"]


def default_parser(language: str, content: str) -> list[Definition] | None:
    return python_definitions(content) if language == "python" else brace_definitions(content)


def chunk_file(relpath: str | None, content: str | None, parser: Parser = default_parser) -> list[dict]:
    """Chunks with 1-based inclusive lines; none for generated files and those with a NUL."""
    if content is None or "\0" in content or any(K.GENERATED_MARK in x for x in content.split("\n")[: K.GENERATED_LINES]):
        return []
    lines = split_lines(content)
    extension = (relpath or "").rsplit("/", 1)[-1].rpartition(".")
    language = K.LANGUAGES.get(extension[2]) if extension[1] else None
    definitions = parser(language, content) if language else None
    spans = coalesce(definition_spans(lines, definitions)) if definitions else windows(lines)
    return [{"start_line": s + 1, "end_line": e, "symbol": symbol, "content": "\n".join(lines[s:e])} for s, e, symbol in spans]


_PARTS = {"seq": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "symbol": pa.string(), "content": pa.string()}


def _table(keys: pa.RecordBatch, own: dict[str, list], parts: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Chunks of the files of a batch, with the keys of the files in their rows."""
    at = keys.take(pa.array(own["row"], pa.int64()))
    columns = [pa.array(own[name], kind) for name, kind in parts.items()]
    return pa.RecordBatch.from_arrays([*at.columns, *columns], names=[*keys.schema.names, *parts])


def cutter(told: Sequence[str], parser: Parser = default_parser, numbered: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of files (relpath, content and what is `told` of them) -> batches of their chunks, told the same.

    If `numbered`, chunks have their number within their task, from 0, and before the chunks of a file comes a row that is
    null in all but what is told of the file."""
    parts = _PARTS | ({"number": pa.int64()} if numbered else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            keys, own, held = batch.select(told), {name: [] for name in ("row", *parts)}, 0
            for row, (path, content) in enumerate(zip(batch.column("relpath"), batch.column("content"))):
                if numbered:
                    for name in own:
                        own[name].append(row if name == "row" else None)
                for seq, chunk in enumerate(chunk_file(path.as_py(), content.as_py(), parser)):
                    for name, value in (("row", row), ("seq", seq), *chunk.items(), *((("number", made),) if numbered else ())):
                        own[name].append(value)
                    held, made = held + len(chunk["content"]), made + 1
                if held >= CUT_LETTERS or row == batch.num_rows - 1:
                    yield _table(keys, own, parts)
                    own, held = {name: [] for name in own}, 0

    return cut


def chunk_files(files: DataFrame, parser: Parser = default_parser) -> DataFrame:
    """repo_key, relpath, seq, start_line, end_line, symbol, content of files (repo_key, relpath, content).

    Files are cut one after another and chunks handed on whenever they hold CUT_LETTERS, whatever the size of a batch."""
    kinds = [files.schema[c].dataType.simpleString() for c in ("repo_key", "relpath")]
    cut = cutter(["repo_key", "relpath"], parser)
    return files.select("repo_key", "relpath", "content").mapInArrow(cut, f"repo_key {kinds[0]}, relpath {kinds[1]}, seq int, start_line int, end_line int, symbol string, content string")
