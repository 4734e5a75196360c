"""Reading model texts: YAML by the rules of its version 1.2 (core schema) and JSON, the same whatever is installed.

Block and flow style, quotes, comments, block scalars, anchors and aliases, tags and explicit keys are read. Plain words
are null, true, false, numbers or text, so ``yes``, ``010`` and dates are what 1.2 makes of them. ``<<`` merges mappings, as
most tools do. A tag of the core schema says what its node is; any other stays with its value as ``{"!tag": value}``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from hashlib import blake2b

NULLS, BOOLS = {"", "~", "null", "Null", "NULL"}, {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_NUMBER = re.compile(r"[-+]?(?:0o[0-7]+|0x[0-9a-fA-F]+|(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")
_BLANK = re.compile(r"[ \t]*(?:#.*)?")
_PLAIN_END = re.compile(r":(?=[ \t\n]|$)|[ \t]#|\n")
_FLOW_PLAIN = re.compile(r"(?:[^,\[\]{}:#\n]|:(?=[^ \t\n,\[\]{}])|(?<![ \t\n])#)*")
_FLOW_SPACE = re.compile(r"(?:[ \t\n]+(?:#[^\n]*)?)*")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*)'", re.S)
_BREAKS = re.compile(r"[ \t]*\n[ \t\n]*")
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\n[ \t]*|.)", re.S)
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_PROPERTY = re.compile(r"(?:&([^\s,\[\]{}]+)|!(<[^>\s]*>|[^\s,\[\]{}]*))(?=[\s,\[\]{}]|$)[ \t]*")
_ALIAS = re.compile(r"\*([^\s,\[\]{}]+)")
#: Lines that need no closer look: a name alone, or with a short plain or single-quoted value.
_ENTRY = re.compile(r"( *)([A-Za-z_][A-Za-z0-9_.-]*):(?: +(?:([A-Za-z_][A-Za-z0-9_./ -]*)|'([^']*)'))? *")
#: Characters that aliases may stand for in one text.
MOST_EXPANDED = 100_000_000
_CORE = {"!str": str, "!int": int, "!float": (int, float), "!bool": bool, "!null": type(None), "!map": dict, "!seq": list}
_HEADER = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)[ \t]*(?:#.*)?$")


class Unreadable(ValueError):
    """The text is no YAML."""


def scalar(text: str):
    """The value of a plain scalar."""
    if text in NULLS:
        return None
    if text in BOOLS:
        return BOOLS[text]
    if text[0] in "+-.0123456789" and _NUMBER.fullmatch(text):
        if text.startswith(("0o", "0x")):
            return int(text[2:], 8 if text[1] == "o" else 16)
        try:
            return int(text)
        except ValueError:
            return float(text.lower().replace(".inf", "inf").replace(".nan", "nan"))
    return text


def _folded(text: str) -> str:
    """Line folding inside quotes: one break is a space, n + 1 breaks are n line ends."""
    return _BREAKS.sub(lambda m: "\n" * (m[0].count("\n") - 1) or " ", text) if "\n" in text else text


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "xuU" and len(e) > 1:
            return chr(int(e[1:], 16))
        return "" if e[0] == "\n" else _ESCAPES.get(e, e)

    if "\\" not in text:
        return _folded(text)
    parts, at = [], 0
    for m in _ESCAPE.finditer(text):
        parts += [_folded(text[at : m.start()]), one(m)]
        at = m.end()
    return "".join([*parts, _folded(text[at:])])


class _Reader:
    def __init__(self, text: str) -> None:
        text = text.lstrip("\ufeff")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.text, self.lines = text, text.split("\n")
        self.offsets, at = [], 0
        for line in self.lines:
            self.offsets.append(at)
            at += len(line) + 1
        self.i = 0
        self.anchors: dict[str, tuple[object, int]] = {}
        self.expanded = 0

    def document(self):
        while self._next() is not None and (self.lines[self.i].startswith(("%", "---"))):
            line = self.lines[self.i]
            if line.startswith("---") and not _BLANK.fullmatch(line[3:]):
                if line[3] not in " \t":
                    break
                self.lines[self.i] = " " * 3 + line[3:]
                rest = line[3:].lstrip()
                if rest[0] in "&!|>":  # properties of what follows, or a block scalar
                    value = self.value(self.offsets[self.i] + len(line) - len(rest), -1)
                else:
                    value = self.block(0)
                return self._ended(value)
            self.i += 1
        return self._ended(self.block(0))

    def _ended(self, value):
        if (rest := self._next()) is not None and not self.lines[rest].startswith("..."):
            raise Unreadable(f"line {rest + 1} belongs nowhere")
        return value

    def _properties(self, at: int) -> tuple[str | None, str | None, int]:
        """The anchor and tag written here, and where the node itself begins."""
        anchor = tag = None
        while self.text[at : at + 1] in ("&", "!") and (m := _PROPERTY.match(self.text, at)):
            if m[1] is not None:
                anchor = m[1]
            else:
                tag = "!" + m[2]
                if tag.startswith("!<") or tag.startswith("!!"):
                    tag = "!" + tag[2:].rstrip(">").removeprefix("tag:yaml.org,2002:") if tag[1] == "<" else tag[1:]
                    tag = tag if tag in _CORE else "!" + tag
            at = m.end()
        return anchor, tag, at

    def _node(self, at: int, read):
        """A node with properties; ``read(at, as_text)`` reads what they are about and gives it with the place behind it."""
        start, before = at, self.expanded
        anchor, tag, at = self._properties(at)
        if at == start:
            raise Unreadable(f"{self.text[at]!r} begins no property")
        value, end = read(at, tag is not None and tag not in ("!int", "!float", "!bool", "!null"))
        value = self._tagged(value, tag)
        if anchor:
            self.anchors[anchor] = value, end - start + self.expanded - before
        return value, end

    @staticmethod
    def _tagged(value, tag: str | None):
        if tag is None or tag == "!":
            return value
        if tag not in _CORE:
            return {tag: value}
        if value is None and tag in ("!str", "!map", "!seq"):
            return _CORE[tag]()
        if isinstance(value, str) and tag in ("!int", "!float", "!bool", "!null"):
            value = scalar(value)  # it was quoted
        if not isinstance(value, _CORE[tag]) or (isinstance(value, bool) and tag in ("!int", "!float")):
            raise Unreadable(f"{value!r} is no {tag[1:]}")
        return float(value) if tag == "!float" else value

    def _alias(self, at: int):
        m = _ALIAS.match(self.text, at)
        if not m or m[1] not in self.anchors:
            raise Unreadable("an alias of nothing")
        value, size = self.anchors[m[1]]
        self.expanded += size
        if self.expanded > MOST_EXPANDED:
            raise Unreadable("aliases stand for too much")
        return value, m.end()

    def _next(self) -> int | None:
        """Moves to the next line with content."""
        lines, i = self.lines, self.i
        while i < len(lines):
            line = lines[i].lstrip(" \t")
            if line and line[0] != "#":
                self.i = i
                return i
            i += 1
        self.i = i
        return None

    def _line(self) -> tuple[int, str] | None:
        i = self._next()
        if i is None:
            return None
        line = self.lines[i]
        content = line.lstrip(" ")
        if content[0] == "\t":
            raise Unreadable("a tab indents")
        indent = len(line) - len(content)
        return None if indent == 0 and (content.startswith("...") or content == "---") else (indent, content)

    def block(self, least: int):
        """The node whose first line is indented by ``least`` or more."""
        found = self._line()
        if found is None or found[0] < least:
            return None
        indent, content = found
        if content == "-" or content.startswith("- "):
            return self.sequence(indent)
        if content == "?" or content.startswith("? ") or self._key(self.offsets[self.i] + indent, False) is not None:
            return self.mapping(indent)
        return self.value(self.offsets[self.i] + indent, indent - 1)

    def sequence(self, indent: int) -> list:
        items = []
        while (found := self._line()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:]
            inner = rest.lstrip(" ")
            if _BLANK.fullmatch(rest):
                self.i += 1
                items.append(self.block(indent + 1))
                continue
            at = indent + len(found[1]) - len(inner)
            start = self.offsets[self.i] + at
            if inner in ("-", "?") or inner.startswith(("- ", "? ")) or self._key(start, False) is not None:
                # A collection that starts beside the dash: read its line as if the dash were blank.
                self.lines[self.i] = " " * at + inner
                items.append(self.block(at))
            else:
                items.append(self.value(start, indent))
        if found and found[0] > indent:
            raise Unreadable(f"line {self.i + 1} is indented too far")
        return items

    def mapping(self, indent: int) -> dict:
        found, merged, lines = {}, [], self.lines
        while True:
            if self.i < len(lines) and (m := _ENTRY.fullmatch(lines[self.i])) and m.end(1) == indent and (name := m[2]) not in BOOLS and name not in NULLS:
                below = lines[self.i + 1] if self.i + 1 < len(lines) else "-"
                if m[4] is not None:
                    found[name] = m[4]
                    self.i += 1
                    continue
                if m[3] is not None and below[: indent + 1].strip(" "):  # what follows does not go on with the value
                    found[name] = scalar(m[3].rstrip(" "))
                    self.i += 1
                    continue
                if m[3] is None:
                    self.i += 1
                    found[name] = self._below(indent)
                    continue
            line = self._line()
            if not line or line[0] != indent or line[1] == "-" or line[1].startswith("- "):
                break
            if line[1] == "?" or line[1].startswith("? "):
                name = _key_text(self._explicit(indent))
                line, value = self._line(), None
                if line and line[0] == indent and (line[1] == ":" or line[1].startswith(": ")):
                    value = self._explicit(indent)
                found[name] = value
                continue
            key = self._key(self.offsets[self.i] + indent)
            if key is None:
                raise Unreadable(f"line {self.i + 1} has no key")
            name, at = key
            line_end = self.offsets[self.i] + len(lines[self.i])
            plain = self.text[at - 3 : at] == "<<:"
            if _BLANK.fullmatch(self.text, at, line_end):
                self.i += 1
                value = self._below(indent)
            else:
                while self.text[at] in " \t":
                    at += 1
                value = self.value(at, indent, indent)
            if name == "<<" and plain and _maps(value):
                merged += value if isinstance(value, list) else [value]
            else:
                found[name] = value
        if line and line[0] > indent:
            raise Unreadable(f"line {self.i + 1} is indented too far")
        for more in merged:
            for k, v in more.items():
                found.setdefault(k, v)
        return found

    def _below(self, indent: int):
        """The value of a key with nothing beside it: deeper, or a list at the key's own indentation."""
        below = self._line()
        if below and below[0] == indent and (below[1] == "-" or below[1].startswith("- ")):
            return self.sequence(indent)
        return self.block(indent + 1)

    def _explicit(self, indent: int):
        """The node behind a ``?`` or ``:`` that begins a line: read as if the mark were blank."""
        line = self.lines[self.i]
        rest = line[indent + 1 :]
        if _BLANK.fullmatch(rest):
            self.i += 1
            return self._below(indent)
        inner = rest.lstrip(" ")
        at = len(line) - len(inner)
        start = self.offsets[self.i] + at
        if inner in ("-", "?") or inner.startswith(("- ", "? ")) or self._key(start, False) is not None:
            self.lines[self.i] = " " * at + inner
            return self.block(at)
        return self.value(start, indent)

    def _key(self, at: int, note: bool = True) -> tuple[str, int] | None:
        """The key that starts here and where its value may start; None: no key. ``note``: remember the key's anchor."""
        text, first = self.text, self.text[at]
        if first in "&!":
            anchor, tag, start = self._properties(at)
            if start == at:
                raise Unreadable(f"{first!r} begins no property")
            if start >= len(text) or text[start] == "\n" or text[start] in "#&!" or (key := self._key(start, note)) is None:
                return None
            if tag not in (None, "!", "!str"):
                key = f"{tag} {key[0]}" if tag not in _CORE else key[0], key[1]
            if anchor and note:
                self.anchors[anchor] = key[0], len(key[0])
            return key
        if first == "*":
            m = _ALIAS.match(text, at)
            end = at if not m else m.end()
            while text[end : end + 1] in (" ", "\t"):
                end += 1
            if text[end : end + 1] != ":" or text[end + 1 : end + 2] not in ("", " ", "\t", "\n"):
                return None
            return _key_text(self._alias(at)[0]), end + 1
        if first in "\"'":
            m = (_DOUBLE if first == '"' else _SINGLE).match(text, at)
            if not m or "\n" in m[0]:
                return None
            end = m.end()
            while end < len(text) and text[end] in " \t":
                end += 1
            if text[end : end + 1] != ":" or text[end + 1 : end + 2] not in ("", " ", "\t", "\n"):
                return None
            return (_unescaped(m[1]) if first == '"' else m[1].replace("''", "'")), end + 1
        if first in "[{":
            return None
        if first in "|>%@`":
            if first in "|>":
                return None
            raise Unreadable(f"{first!r} begins no text")
        m = _PLAIN_END.search(text, at)
        if not m or m[0] != ":":
            return None
        return _key_text(scalar(text[at : m.start()].rstrip())), m.end()

    def value(self, at: int, parent: int, of_key: int | None = None, as_text: bool = False):
        """A node that starts here, within one indented by ``parent``; moves past it.

        ``of_key``: the indentation of the key it belongs to, where a list may begin at that below its properties.
        """
        text, first = self.text, self.text[at]
        if first in "&!":

            def read(at: int, as_text: bool):
                if not _BLANK.fullmatch(text, at, self.offsets[self.i] + len(self.lines[self.i])):
                    if text[at] == "*":
                        raise Unreadable("an alias has properties")
                    value = self.value(at, parent, of_key, as_text)
                else:
                    self.i += 1
                    value = self.block(parent + 1) if of_key is None else self._below(of_key)
                return value, self.offsets[self.i] if self.i < len(self.offsets) else len(text)

            return self._node(at, read)[0]
        if first == "*":
            value, end = self._alias(at)
            if not _BLANK.fullmatch(text, end, self.offsets[self.i] + len(self.lines[self.i])):
                raise Unreadable(f"line {self.i + 1} goes on after its alias")
            self.i += 1
            return value
        if first in "\"'[{":
            value, end = self.flow(at)
            self.i = bisect_right(self.offsets, end - 1) - 1
            if not _BLANK.fullmatch(text, end, self.offsets[self.i] + len(self.lines[self.i])):
                raise Unreadable(f"line {self.i + 1} goes on after its value")
            self.i += 1
            return value
        if first in "|>":
            return self._literal(text[at : self.offsets[self.i] + len(self.lines[self.i])], parent)
        if first in "%@`":
            raise Unreadable(f"{first!r} begins no text")
        end = self.offsets[self.i] + len(self.lines[self.i])
        parts, comment = [], re.search(r"[ \t]#", text[at:end])
        parts.append(text[at : at + comment.start() if comment else end].strip())
        if re.search(r":(?:[ \t]|$)", parts[0]):
            raise Unreadable(f"line {self.i + 1} has a key in its value")
        self.i += 1
        breaks = 0
        while not comment and self.i < len(self.lines):
            line = self.lines[self.i]
            content = line.strip(" \t")
            if not content:
                breaks += 1
            elif len(line) - len(line.lstrip(" ")) <= parent or content[0] == "#" or line.startswith(("---", "...")):
                break
            else:
                comment = re.search(r"[ \t]#", line)
                content = line[: comment.start()].strip() if comment else content
                if re.search(r":(?:[ \t]|$)", content):
                    raise Unreadable(f"line {self.i + 1} has a key in a scalar")
                parts.append("\n" * breaks or " ")
                parts.append(content)
                breaks = 0
            self.i += 1
        return scalar(parts[0]) if len(parts) == 1 and not as_text else "".join(parts)

    def _literal(self, header: str, parent: int) -> str:
        m = _HEADER.match(header)
        if not m:
            raise Unreadable("a block scalar's header")
        chomp, given = m[2] or m[4], m[3]
        self.i += 1
        lines, indent = [], parent + int(given) if given and parent >= 0 else int(given) if given else None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            content = line.lstrip(" ")
            if content:
                own = len(line) - len(content)
                if indent is None and own > parent:
                    indent = own
                if indent is None or own < indent:
                    break
            lines.append(line[indent:] if indent is not None else "")
            self.i += 1
        tail = 0
        while lines and not lines[-1].strip(" "):
            lines.pop()
            tail += 1
        if m[1] == "|":
            body = "\n".join(lines)
        else:
            body, plain = "", False
            for k, line in enumerate(lines):
                now = bool(line) and line[0] not in " \t"
                if k == 0:
                    body = line
                elif not line:
                    body += "\n"
                elif now and plain and lines[k - 1]:
                    body += " " + line
                elif now and plain:
                    body += line
                else:
                    body += "\n" + line
                plain = now or (plain and not line)
        return body + ("" if chomp == "-" or not lines else "\n" * (tail or 1) if chomp == "+" else "\n")

    def flow(self, at: int, as_text: bool = False):
        """A flow node and the place behind it."""
        text = self.text
        at = _FLOW_SPACE.match(text, at).end()
        first = text[at : at + 1]
        if first in ("&", "!"):

            def read(at: int, as_text: bool):
                at = _FLOW_SPACE.match(text, at).end()
                return (None, at) if text[at : at + 1] in (",", "]", "}", ":") else self.flow(at, as_text)

            return self._node(at, read)
        if first == "*":
            return self._alias(at)
        if first == '"' or first == "'":
            m = (_DOUBLE if first == '"' else _SINGLE).match(text, at)
            if not m:
                raise Unreadable("a quote is open")
            return (_unescaped(m[1]) if first == '"' else _folded(m[1].replace("''", "'"))), m.end()
        if first == "[":
            items, at = [], at + 1
            while True:
                at = _FLOW_SPACE.match(text, at).end()
                if text[at : at + 1] == "]":
                    return items, at + 1
                value, at = self.flow(at)
                at = _FLOW_SPACE.match(text, at).end()
                if text[at : at + 1] == ":":
                    inner, at = self.flow(at + 1)
                    value, at = {_key_text(value): inner}, _FLOW_SPACE.match(text, at).end()
                items.append(value)
                if text[at : at + 1] == ",":
                    at += 1
                elif text[at : at + 1] != "]":
                    raise Unreadable("a list is open")
        if first == "{":
            found, merged, at = {}, [], at + 1
            while True:
                at = _FLOW_SPACE.match(text, at).end()
                if text[at : at + 1] == "}":
                    for more in merged:
                        for k, v in more.items():
                            found.setdefault(k, v)
                    return found, at + 1
                if text[at] == "?" and text[at + 1 : at + 2] in (" ", "\t", "\n"):
                    at += 1
                merges = text.startswith("<<", at)
                key, at = self.flow(at)
                at = _FLOW_SPACE.match(text, at).end()
                value = None
                if text[at : at + 1] == ":":
                    at = _FLOW_SPACE.match(text, at + 1).end()
                    if text[at : at + 1] not in (",", "}"):
                        value, at = self.flow(at)
                        at = _FLOW_SPACE.match(text, at).end()
                if merges and key == "<<" and _maps(value):
                    merged += value if isinstance(value, list) else [value]
                else:
                    found[_key_text(key)] = value
                if text[at : at + 1] == ",":
                    at += 1
                elif text[at : at + 1] != "}":
                    raise Unreadable("a mapping is open")
        if first in "|>%@`" or not first:
            raise Unreadable(f"{first!r} begins no text")
        m = _FLOW_PLAIN.match(text, at)
        parts, end = [m[0].strip()], at + len(m[0].rstrip(" \t"))
        while text[end : end + 1] in (" ", "\t", "\n") and "\n" in _FLOW_SPACE.match(text, end)[0] and (go := _FLOW_SPACE.match(text, end).end()) and text[go : go + 1] not in ("", ",", "]", "}", ":"):
            m = _FLOW_PLAIN.match(text, go)
            if not m[0]:
                break
            parts.append(m[0].strip())
            end = go + len(m[0].rstrip(" \t"))
        if parts == [""] and end == at:
            raise Unreadable("a value is missing")
        return " ".join(parts) if as_text else scalar(" ".join(parts)), end


def _maps(value) -> bool:
    return isinstance(value, dict) or (isinstance(value, list) and all(isinstance(v, dict) for v in value))


def _key_text(key) -> str:
    return key if isinstance(key, str) else json.dumps(key)


def _no_constant(name: str):
    raise ValueError(name)


def load(text: str):
    """The value of a YAML text; :class:`Unreadable` where it has none."""
    try:
        if text.startswith("{"):
            try:
                return json.loads(text, parse_constant=_no_constant)
            except ValueError:
                pass
        return _Reader(text).document()
    except (Unreadable, IndexError, RecursionError, OverflowError) as e:
        raise Unreadable(str(e) or type(e).__name__) from e


def canonical(value) -> str:
    """One text for equal parsed values: key order is dropped, list order kept, 1.0 equals 1."""

    def plain(v):
        if isinstance(v, dict):
            return {_key_text(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def content_hash(value) -> bytes:
    return blake2b(canonical(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()
