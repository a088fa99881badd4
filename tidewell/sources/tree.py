"""Elements and texts of one HTML page: the helper that tasks of :func:`tidewell.sources.html.elements` run on Arrow batches.

A page is read once from its start to its end; work and memory go with its tokens. Expressions name the characters that
Java's do: white space of tags is that of ASCII, letters of names are told apart by ASCII case alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa

#: Elements without content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Tokens after which a batch of pages is handed on, and ancestors up to which a link carries them.
TOKENS, AROUND = 50_000, 64
#: Tags that a task keeps in mind.
TAGS = 10_000

_S = r" \t\n\x0b\f\r"
_SCRIPT, _STYLE = "[sS][cC][rR][iI][pP][tT]", "[sS][tT][yY][lL][eE]"
#: Groups: a tag, a piece of text; comments, scripts, styles and declarations have none.
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<{_SCRIPT}\b[^>]*+>.*?(?:</{_SCRIPT}[{_S}]*>|\Z)|<{_STYLE}\b[^>]*+>.*?(?:</{_STYLE}[{_S}]*>|\Z)"""
    rf"""|(</?[a-zA-Z][^{_S}/>]*+[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>)|<[!?][^>]*+>|([^<]++|<)""",
    re.DOTALL,
)
_NAME = re.compile(rf"</?([a-zA-Z][^{_S}/>]*)")
_HREF, _CLASS = (re.compile(rf"""[{_S}"']{name}[{_S}]*=[{_S}]*("[^"]*"|'[^']*'|[^{_S}"'>]+)""") for name in ("[hH][rR][eE][fF]", "[cC][lL][aA][sS][sS]"))
_WIDE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000"
_EDGES = "".join(chr(code) for code in range(0x3001) if re.match(f"[ {_WIDE}]", chr(code)))
#: White space that is not one space.
_SPACE = re.compile(f"[ {_WIDE}]{{2,}}|[{_WIDE}]")
_REFERENCE = re.compile("&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")
_NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def _character(found: re.Match) -> str:
    number, hexadecimal, name = found.groups()
    if name:
        return _NAMES.get(name, found[0])
    code = int(number) if number else int(hexadecimal, 16)
    return chr(code) if 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF else "\ufffd"


def unescaped(text: str) -> str:
    """:func:`tidewell.functions.text.unescape` of one text."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def _attribute(pattern: re.Pattern, tag: str) -> str | None:
    found = pattern.search(tag)
    if not found:
        return None
    value = found[1]
    return unescaped(value[1:-1] if value[0] in "\"'" else value)


def _tag(tag: str) -> tuple[int, str, bool, str | None, str | None]:
    """1 for a start and -1 for an end (0: it counts for nothing), name, whether it has no content, href and classes."""
    name, start = _NAME.match(tag)[1].lower(), tag[1] != "/"
    if name in ("script", "style") or not start and name in VOID:
        return 0, name, False, None, None
    if not start:
        return -1, name, False, None, None
    classes = _attribute(_CLASS, tag)
    return 1, name, tag.endswith("/>") or name in VOID, _attribute(_HREF, tag), classes.lower() if classes is not None else None


def page_elements(html: str, seen: dict[str, tuple] | None = None) -> tuple[list[tuple], list[str]]:
    """The elements of a page, in order of their start tags, and its pieces of text; ``seen`` holds tags read before.

    An element: at, stop, name, href, classes, texts, texts_end, starts, inner_end, up (places of the elements around a
    link in the array, nearest first; null for others and where they are many).
    """
    seen = {} if seen is None else seen
    starts: list[tuple] = []  # at, name, href, classes, texts
    texts: list[str] = []
    ends: list[tuple | None] = []  # at, texts, starts
    order: list[int] = []  # starts, and the complement of the start that a closing tag closes
    opened: dict[str, list[int]] = {}
    last = -1
    for at, (tag, text) in enumerate(_TOKEN.findall(html)):
        if tag:
            if (told := seen.get(tag)) is None:
                told = seen[tag] = _tag(tag)
            kind, name, empty, href, classes = told
            if kind > 0:
                last = at
                starts.append((at, name, href, classes, len(texts)))
                if empty:
                    ends.append((at, len(texts), len(starts)))
                else:
                    order.append(len(ends))
                    opened.setdefault(name, []).append(len(ends))
                    ends.append(None)
            elif kind < 0:
                last = at
                if same := opened.get(name):
                    order.append(~(start := same.pop()))
                    ends[start] = (at, len(texts), len(starts))
        elif text and (text := text.strip(_EDGES)) and (text := _SPACE.sub(" ", unescaped(text)).strip(" ")):
            texts.append(text)
            last = at
    # An element that nothing closes ends with the closed one around it: the next end at the same depth.
    if any(opened.values()):
        depth, waiting = 0, {}
        for start in order:
            if start < 0:
                for lost in waiting.pop(depth, ()):
                    ends[lost] = ends[~start]
                depth -= 1
            elif ends[start] is None:
                waiting.setdefault(depth, []).append(start)
            else:
                depth += 1
        for lost in (i for rest in waiting.values() for i in rest):
            ends[lost] = (last + 1, len(texts), len(starts))
    elements, around = [], []
    for i, ((at, name, href, classes, before), (stop, texts_end, inner_end)) in enumerate(zip(starts, ends)):
        while around and ends[around[-1]][0] <= at:
            around.pop()
        up = [j for j in reversed(around) if ends[j][0] > at] if href is not None and name == "a" and len(around) <= AROUND else None
        elements.append((at, stop, name, href, classes, before, texts_end, i + 1, inner_end, up))
        if stop > at:
            around.append(i)
    return elements, texts


_INT, _TEXT = pa.int32(), pa.string()
_FIELDS = {"at": _INT, "stop": _INT, "name": _TEXT, "href": _TEXT, "classes": _TEXT, "texts": _INT, "texts_end": _INT, "starts": _INT, "inner_end": _INT, "up": pa.list_(_INT)}
#: What a row of :func:`read_pages` has besides its key.
ELEMENTS = "elements array<struct<at int, stop int, name string, href string, classes string, texts int, texts_end int, starts int, inner_end int, up array<int>>>, texts array<string>"


def _lists(of: list[list], values: pa.Array) -> pa.Array:
    ends = [0]
    for items in of:
        ends.append(ends[-1] + len(items))
    return pa.ListArray.from_arrays(pa.array(ends, _INT), values)


def _batch(keys: pa.Array, places: list[int], elements: list[list], texts: list[list]) -> pa.RecordBatch:
    columns = list(zip(*(e for page in elements for e in page))) or [()] * len(_FIELDS)
    rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _FIELDS.values())], list(_FIELDS))
    pieces = pa.array([t for page in texts for t in page], _TEXT)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), _lists(elements, rows), _lists(texts, pieces)], ["key", "elements", "texts"])


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, elements, texts of pages (key, html); pages that have neither are left out."""
    seen: dict[str, tuple] = {}
    for batch in batches:
        keys, places, elements, texts, held = batch.column(0), [], [], [], 0
        for place, html in enumerate(batch.column(1)):
            found, pieces = page_elements(html.as_py() or "", seen)
            if len(seen) > TAGS:
                seen.clear()
            if not found and not pieces:
                continue
            places.append(place)
            elements.append(found)
            texts.append(pieces)
            held += len(found) + len(pieces)
            if held >= TOKENS:
                yield _batch(keys, places, elements, texts)
                places, elements, texts, held = [], [], [], 0
        if places:
            yield _batch(keys, places, elements, texts)
