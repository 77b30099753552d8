"""Declarations of source text in one pass.

A lexer walks over the text once with a stack of what is open: brackets, blocks
closed by a keyword, strings whose code parts are being read.  Tables say for
each language what its comments, strings and declaring words are.  A declaration
waits from its header to its own opening bracket or keyword, rides on that stack
entry and ends where the entry is closed, so brackets in strings and comments
don't count and the time follows the length of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Chunk:
    start_line: int
    end_line: int
    chunk_type: str
    name: str
    parent: str


@dataclass(frozen=True)
class Text:
    """A string with code parts: how it begins, what ends it, what opens a part
    and what closes that; whether it may hold line ends."""

    begins: str
    ends: str
    opens: str
    closes: str = "}"
    lines: bool = False


@dataclass(frozen=True)
class Language:
    #: Patterns of comments and of strings that are skipped as wholes.
    skipped: tuple[str, ...]
    #: Declaring words with the type of chunk they make.
    words: dict[str, str]
    texts: tuple[Text, ...] = ()
    #: Comments in comments are counted.
    nested: bool = False
    #: In the body of a type a name with parentheses before its body is a method.
    methods: bool = False
    #: Such a method may end at ';' without a body.
    bodiless: bool = False
    #: A line end closes a declaration that has no body and isn't going on.
    by_lines: bool = False
    #: '/' begins a regular expression where no value stands before it.
    regex: bool = False
    #: '@' begins annotations, which belong to the declaration below.
    marks: bool = False


_LINE, _BLOCK, _HASH = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\(?s:.))*"?', r"'(?:[^'\\\n]|\\(?s:.))*'?"
_TRIPLE = r'"""(?s:(?:[^\\"]|\\.|"(?!""))*)(?:"""|\Z)'
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
_JS = dict(skipped=(_LINE, _BLOCK, _DOUBLE, _SINGLE), texts=(Text("`", "`", "${", lines=True),), methods=True, by_lines=True, regex=True, marks=True)

LANGUAGES = {
    "typescript": Language(**_JS, words={"class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module", "function": "function"}),
    "javascript": Language(**_JS, words={"class": "class", "function": "function"}),
    "java": Language((_LINE, _BLOCK, _TRIPLE, _DOUBLE, _CHAR), {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, methods=True, bodiless=True, marks=True),
    "csharp": Language(
        (_LINE, _BLOCK, r"(?m:^[ \t]*#[^\n]*)", _TRIPLE, r'@"(?:[^"]|"")*(?:"|\Z)', _DOUBLE, _CHAR),
        {"class": "class", "struct": "class", "interface": "interface", "enum": "enum", "record": "class", "namespace": "module"},
        (Text('$"', '"', "{"), Text('$@"', '"', "{", lines=True), Text('@$"', '"', "{", lines=True)), methods=True, bodiless=True,
    ),
    "kotlin": Language((_LINE, _CHAR), {"class": "class", "object": "class", "interface": "interface", "fun": "function"}, (Text('"""', '"""', "${", lines=True), Text('"', '"', "${")), nested=True, by_lines=True, marks=True),
    "scala": Language((_LINE, _CHAR, r"'[A-Za-z_]\w*"), {"class": "class", "object": "class", "trait": "interface", "def": "function"}, (Text('"""', '"""', "${", lines=True), Text('"', '"', "${")), nested=True, by_lines=True, marks=True),
    "go": Language((_LINE, _BLOCK, _DOUBLE, _CHAR, r"`[^`]*(?:`|\Z)"), {"func": "function", "type": "type"}, by_lines=True),
    "rust": Language((_LINE, r'\bb?r(?P<hash>#*)"(?s:.*?)(?:"(?P=hash)|\Z)', r'\bb?"(?s:[^"\\]|\\.)*(?:"|\Z)|"(?s:[^"\\]|\\.)*(?:"|\Z)', r"b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'", r"'[A-Za-z_]\w*"), {"fn": "function", "struct": "class", "enum": "enum", "trait": "interface", "impl": "module", "mod": "module"}, nested=True),
    "php": Language(
        (_LINE, r"#(?!\[)[^\n]*", _BLOCK, r"\?>(?s:.*?)(?:<\?(?:php|=)?|\Z)", r"<<<[ \t]*([\"']?)(?P<doc>\w+)[\"']?[ \t]*\n(?s:.*?)(?:^[ \t]*(?P=doc)\b|\Z)", r"'(?s:[^'\\]|\\.)*(?:'|\Z)"),
        {"class": "class", "interface": "interface", "trait": "interface", "enum": "enum", "namespace": "module", "function": "function"}, (Text('"', '"', "{$", lines=True),),
    ),
    "swift": Language((_LINE, r'#"(?s:.*?)(?:"#|\Z)'), {"class": "class", "struct": "class", "actor": "class", "enum": "enum", "extension": "module", "protocol": "interface", "func": "function", "init": "function"}, (Text('"""', '"""', "\\(", ")", lines=True), Text('"', '"', "\\(", ")")), nested=True, by_lines=True, marks=True),
    "ruby": Language(
        (r"(?m:^=begin\b)(?s:.*?)(?:^=end\b[^\n]*|\Z)", _HASH, r"'(?s:[^'\\]|\\.)*(?:'|\Z)", r"%[wWiIqQ]?(?:\[[^\]]{0,2000}\]|\([^)]{0,2000}\)|\{[^}]{0,2000}\})", r"(?m:^__END__$)(?s:.*)", r"\?[^\s\w]", r":\"(?:[^\"\\\n]|\\.)*\""),
        {"class": "class", "module": "module", "def": "function"}, (Text('"', '"', "#{", lines=True), Text("`", "`", "#{", lines=True)), by_lines=True, regex=True,
    ),
}
TYPES = {"class", "interface", "module", "enum", "type"}
#: Words before a parenthesis and a bracket that aren't a method's name.
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "with", "try", "new", "throw", "using", "lock", "synchronized", "foreach", "await", "super", "this", "when", "fixed"}
_REGEX = re.compile(r"/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words and marks after which a statement goes on in the next line, and before
#: which it has gone on.
_GO_ON = {"=", ",", ":", "->", "=>", "+", "-", "*", "/", ".", "&", "|", "(", "[", "{", "?", "<", "extends", "implements", "with", "where", "throws", "in", "async", "else", "=="}
_GONE_ON = {"{", ",", ":", "=", "->", "=>", "+", "*", ".", "&", "|", "?", "extends", "implements", "with", "where", "throws", "else", ")", "]", "?.", ">"}
_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
_RUBY_NAME = re.compile(r"[ \t]+(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*(?:[?!]|=(?=\())?|\[\]=?|[-+*/%<>=!~^&|]+)")
_RUBY_ENDLESS = re.compile(r"[ \t]*(?:\([^()\n]*\))?[ \t]*=(?![=~>])")
_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"


def _patterns(language: Language) -> tuple[re.Pattern, list[re.Pattern]]:
    texts = "|".join(f"(?P<t{i}>{re.escape(t.begins)})" for i, t in enumerate(language.texts))
    # a text of three marks goes before skipped strings, those before texts of one
    code = ["(?P<nested>/\\*)"] if language.nested else []
    code += [texts] if texts else []
    code = [*(f"(?:{x})" for x in language.skipped), *code]
    number = r"(?P<number>\d[\w.]*)"
    whole = re.compile("|".join([f"(?P<skip>{'|'.join(f'(?:{x})' for x in language.skipped)})", *code[len(language.skipped) :], f"(?P<word>{_WORD})", number, r"(?P<mark>=>|->|==|::|\?\.|[^\s\w])", r"(?P<line>\n)"]), re.M)
    inside = []
    for t in language.texts:
        doubled = [re.escape(2 * t.opens)] if t.opens == "{" else []
        escape = [r"\\\(", r"\\(?s:.)"] if t.opens == "\\(" else [r"\\(?s:.)", *doubled, re.escape(t.opens)]
        inside.append(re.compile("|".join([*escape, re.escape(t.ends), *([] if t.lines else [r"\n"])])))
    return whole, inside


_COMPILED = {name: _patterns(x) for name, x in LANGUAGES.items()}


@dataclass
class _Open:
    """A stack entry: what closes it, and the declaration that ends with it."""

    closes: str
    chunk: Chunk | None = None
    text: int | None = None
    loop: bool = False
    # what is known of the statement being read in it
    first_line: int = 0
    mark_line: int = 0
    name: str = ""
    assigned: bool = False
    words: list[str] = field(default_factory=list)


@dataclass
class _Waiting:
    """A declaration whose body hasn't begun."""

    chunk: Chunk
    depth: int
    soft: bool = False


class _Lexer:
    def __init__(self, text: str, name: str):
        self.text, self.name, self.rules = text, name, LANGUAGES[name]
        self.code, self.inside = _COMPILED[name]
        self.stack = [_Open("")]
        self.owners: list[Chunk] = []
        self.found: list[Chunk] = []
        self.waiting: list[_Waiting] = []
        self.line, self.counted = 1, 0
        self.before, self.before_line, self.value = "", 0, False
        self.variable: tuple[int, str, int] | None = None

    def line_at(self, place: int) -> int:
        self.line += self.text.count("\n", self.counted, place)
        self.counted = place
        return self.line

    # declarations

    def declare(self, kind: str, name: str, line: int) -> Chunk:
        parent = self.owners[-1].name if self.owners else ""
        chunk = Chunk(line, line, "method" if kind == "function" and self.owners else kind, name, parent)
        self.found.append(chunk)
        return chunk

    def wait(self, chunk: Chunk, soft: bool = False) -> None:
        self.waiting.append(_Waiting(chunk, len(self.stack), soft))

    def end_waiting(self, line: int) -> None:
        """Ends what waits at this depth or deeper without a body."""
        while self.waiting and self.waiting[-1].depth >= len(self.stack):
            self.waiting.pop().chunk.end_line = line

    def push(self, closes: str, chunk: Chunk | None = None, **more) -> None:
        self.stack.append(_Open(closes, chunk, **more))
        if chunk is not None and chunk.chunk_type in TYPES:
            self.owners.append(chunk)

    def pop(self, line: int) -> _Open:
        self.end_waiting(self.before_line or line)
        entry = self.stack.pop()
        if entry.chunk is not None:
            entry.chunk.end_line = line
            if self.owners and self.owners[-1] is entry.chunk:
                self.owners.pop()
        return entry

    def fresh(self) -> None:
        """The statement at the top of the stack is over."""
        top = self.stack[-1]
        top.first_line = top.mark_line = 0
        top.name, top.assigned = "", False
        self.variable = None

    # the pass

    def run(self) -> list[Chunk]:
        text, at, n = self.text, 0, len(self.text)
        if self.name == "php" and (m := re.search(r"<\?(?:php|=)?", text)):
            at = m.end()
        docs: list[str] = []
        while at < n:
            top = self.stack[-1]
            if top.text is not None:
                at = self.in_text(top, at)
                continue
            m = self.code.search(text, at)
            if m is None:
                break
            kind, at = m.lastgroup, m.end()
            if kind == "line":
                for doc in docs:
                    end = re.compile(rf"^[ \t]*{doc}[ \t]*$", re.M).search(text, at)
                    at = end.end() if end else n
                docs = []
                continue
            if m["skip"] is not None:
                if m["skip"][0] in "\"'`@b%:<r" or (self.name == "swift" and m["skip"][0] == "#"):
                    self.step(m.start(), "''", True)
                continue
            if kind == "nested":
                at = self.comment(at)
                continue
            if kind and kind[0] == "t" and kind[1:].isdigit():
                self.step(m.start(), "''", True)
                self.stack.append(_Open("", text=int(kind[1:])))
                continue
            token = m[0]
            if token == "/" and self.rules.regex and not self.value and (r := _REGEX.match(text, m.start())):
                self.step(m.start(), "''", True)
                at = r.end()
                continue
            if self.name == "ruby":
                if token == "<" and (h := _HEREDOC.match(text, m.start())) and (h[1] or (h[3][0].isupper() and not self.value)):
                    docs.append(h[3])
                    self.step(m.start(), "''", True)
                    at = h.end()
                    continue
                at = self.ruby(m, kind, token, at)
            elif kind == "word":
                self.word(m, token)
            else:
                self.mark(m.start(), token, kind)
        last = self.line_at(n)
        while len(self.stack) > 1:
            self.pop(last)
        self.end_waiting(self.before_line or last)
        return self.found

    def in_text(self, top: _Open, at: int) -> int:
        rule = self.rules.texts[top.text]
        m = self.inside[top.text].search(self.text, at)
        if m is None:
            self.stack.pop()
            return len(self.text)
        if m[0] == rule.opens:
            self.push(rule.closes)
        elif m[0] == rule.ends or m[0] == "\n":
            self.stack.pop()
            self.value = True
        return m.end()

    def comment(self, at: int) -> int:
        """The end of a comment that may hold others."""
        depth = 1
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def step(self, place: int, token: str, value: bool) -> int:
        """The line of a token, once what the line's start ends has ended."""
        line, top = self.line_at(place), self.stack[-1]
        if self.rules.by_lines and self.before_line and line > self.before_line and self.before not in _GO_ON and token not in _GONE_ON and self.before != "@":
            if self.waiting and self.waiting[-1].depth == len(self.stack):
                self.end_waiting(self.before_line)
            if not top.mark_line or top.name or top.assigned:
                self.fresh()
        if not top.first_line:
            top.first_line = line
        self.before, self.before_line, self.value = token, line, value
        return line

    def word(self, m: re.Match, token: str) -> None:
        rules, top, before = self.rules, self.stack[-1], self.before
        line = self.step(m.start(), token, token not in {"return", "typeof", "case", "in", "of", "do", "else", "yield", "await", "throw", "delete", "void"})
        if before in (".", "?.", "::") or (before == "@" and rules.marks):
            return
        ahead = self.text[m.end() : m.end() + 1]
        kind = rules.words.get(token)
        if kind and self.header(m, token, kind, line):
            return
        if token in ("const", "let", "var") and self.name in ("typescript", "javascript"):
            if v := re.compile(rf"\s+({_WORD})\s*[:=]").match(self.text, m.end()):
                self.variable, top.assigned = (len(self.stack), v[1], line), False
            return
        if self.waiting and self.waiting[-1].depth == len(self.stack):
            return
        if rules.methods and top.chunk is not None and top.chunk.chunk_type in TYPES and not top.assigned and not top.name:
            if (ahead in "(<" or self.text[m.end() : m.end() + 8].lstrip()[:1] == "(") and token not in _CONTROL and self.call(m.end()):
                top.name = token
            elif self.name == "csharp" and re.compile(r"\s*(?:\{\s*(?:\[|get|set|init|private|protected|internal)\b|=>)").match(self.text, m.end()):
                self.wait(self.declare("property", token, top.first_line), soft=True)

    def call(self, at: int) -> bool:
        """Whether a parenthesis follows, type parameters aside."""
        return bool(re.compile(r"\s*(?:<[^<>(){};]{0,200}(?:<[^<>(){};]{0,200}>[^<>(){};]{0,200})*>)?\s*\(").match(self.text, at))

    def header(self, m: re.Match, token: str, kind: str, line: int) -> bool:
        """Begins the declaration that a word announces, if it does."""
        text, end, name = self.text, m.end(), None
        follow = re.compile(r"(?:[\s*&]|/\*[^*]*\*/)*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)?").match(text, end).end()
        word = re.compile(_WORD).match(text, follow)
        if self.name == "go" and token == "func":
            # a receiver stands before a method's name
            r = re.compile(rf"\s*(\([^()]*\)\s*)?({_WORD})").match(text, end)
            if not r:
                return False
            name, kind = r[2], "method" if r[1] else "function"
        elif self.name == "go" and token == "type":
            if not word:
                return False
            what = re.compile(r"(?:\[[^\]\n]*\])?\s*=?\s*(struct|interface)\b").match(text, word.end())
            name, kind = word[0], {"struct": "class", "interface": "interface"}.get(what[1] if what else "", "type")
        elif self.name == "kotlin" and token == "fun":
            r = re.compile(rf"\s*(?:<[^<>]*>\s*)?(?:[\w.<>?, *]{{0,200}}\.)?({_WORD}|`[^`\n]+`)\s*\(").match(text, end)
            if not r:
                return False
            name = r[1]
        elif self.name == "rust" and token == "impl":
            r = re.compile(rf"[^{{;]{{0,300}}?\bfor\s+(?:[\w:]{{0,100}}::)?({_WORD})|(?:\w{{1,100}}::){{0,9}}({_WORD})").match(text, follow)
            if not r or self.before_is_type(m.start()):
                return False
            name = r[1] or r[2]
        elif self.name == "swift" and token == "init":
            if not re.compile(r"[?!]?\s*[(<]").match(text, end) or not self.owners:
                return False
            name = "init"
        elif not word or (word[0] in self.rules.words and not (self.name == "kotlin" and token == "enum")):
            if self.name == "kotlin" and token == "object" and re.compile(r"companion\s+$").search(text, max(0, m.start() - 20), m.start()):
                name = "Companion"
            else:
                return False
        else:
            name = word[0]
        if token in ("type", "record", "module", "namespace", "actor", "enum") and self.name in ("typescript", "java", "csharp", "swift", "php") and not re.compile(r"[\s\w.\\]{0,300}[=<{(;:,]|[\w.\\ \t]{0,300}\n").match(text, follow):
            return False
        if self.name == "php" and token == "namespace":
            name = re.compile(r"[\w\\]+").match(text, follow)[0]
        if self.name == "csharp" and token == "namespace":
            name = re.compile(r"[\w.]+").match(text, follow)[0]
        top = self.stack[-1]
        start = top.mark_line or (top.first_line if self.name in ("java", "csharp", "php") and top.first_line else line)
        self.wait(self.declare(kind, name, start), soft=token == "type" and self.name == "typescript")
        return True

    def before_is_type(self, place: int) -> bool:
        """`impl` after these marks is a type, not a declaration."""
        return self.text[max(0, place - 8) : place].rstrip()[-1:] in ("(", ",", ":", ">", "<", "=", "&")

    def mark(self, place: int, token: str, kind: str) -> None:
        top, before = self.stack[-1], self.before
        line = self.step(place, token, kind == "number" or token in (")", "]", "}"))
        waits = self.waiting[-1] if self.waiting and self.waiting[-1].depth == len(self.stack) else None
        if token == "@" and self.rules.marks and not waits:
            top.mark_line = top.mark_line or line
        elif token == "=":
            top.assigned = True
        elif token == "=>" and self.name in ("typescript", "javascript"):
            if not waits and self.variable and self.variable[0] == len(self.stack) and top.assigned:
                self.wait(self.declare("function", self.variable[1], self.variable[2]), soft=True)
                self.variable = None
        elif token == "{":
            self.brace(top, waits, before, line)
        elif token in "([":
            self.push(")" if token == "(" else "]")
        elif token in ")]}":
            self.close(token, line)
        elif token == ";":
            if waits:
                self.end_waiting(line)
            elif top.name and self.rules.bodiless:
                self.declare("function", top.name, top.mark_line or top.first_line).end_line = line
            self.fresh()

    def brace(self, top: _Open, waits: _Waiting | None, before: str, line: int) -> None:
        chunk = None
        if waits and not (waits.chunk.chunk_type in ("function", "method") and not waits.soft and before in (":", "|", "&") or before == "extends"):
            chunk = self.waiting.pop().chunk
        elif not waits and top.name and self.rules.methods and not top.assigned and before not in (":", "|", "&", "extends"):
            chunk = self.declare("function", top.name, top.mark_line or top.first_line or line)
        self.push("}", chunk)

    def close(self, token: str, line: int) -> None:
        # brackets that were never closed end with the one around them
        if all(x.closes != token for x in self.stack[-3:]):
            return
        while self.stack[-1].closes != token:
            self.pop(line)
        entry = self.pop(line)
        if self.stack[-1].text is None and token == "}" and (entry.chunk is not None or not (self.stack[-1].name or self.waiting and self.waiting[-1].depth == len(self.stack))) and not self.stack[-1].assigned:
            self.fresh()

    def ruby(self, m: re.Match, kind: str, token: str, at: int) -> int:
        text, place = self.text, m.start()
        if kind != "word":
            line = self.step(place, token, kind == "number" or token in (")", "]", "}"))
            if token in "([{":
                self.push({"(": ")", "[": "]", "{": "}"}[token])
            elif token in ")]}":
                self.close(token, line)
            return at
        before, same_line, value = self.before, self.before_line, self.value
        line = self.step(place, token, token not in {"return", "and", "or", "not", "if", "unless", "while", "until", "elsif", "when", "in", "then", "do", "else"})
        if before in (".", "?.", "::") or text[place - 1 : place] == ":" or (text[at : at + 1] == ":" and text[at : at + 2] != "::") or text[place - 1 : place] in ("@", "$"):
            return at
        if token == "def" and (name := _RUBY_NAME.match(text, at)):
            chunk = self.declare("function", name[1], line)
            at = name.end()
            self.before, self.value = name[1], True
            if endless := _RUBY_ENDLESS.match(text, at):
                self.wait(chunk)
                self.before = "="
                return endless.end()
            self.push("end", chunk)
        elif token in ("class", "module"):
            name = re.compile(r"[ \t]+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)").match(text, at)
            self.push("end", self.declare(self.rules.words[token], name[1], line) if name else None)
            return name.end() if name else at
        elif token in ("begin", "case") or (token in ("if", "unless", "while", "until", "for") and not (value and same_line == line) and before not in ("return", "break", "next", "redo", "retry")):
            self.push("end", loop=token in ("while", "until", "for"))
        elif token == "do":
            if self.stack[-1].loop:
                self.stack[-1].loop = False
            else:
                self.push("end")
        elif token == "end" and any(x.closes == "end" for x in self.stack[-3:]):
            while self.stack[-1].closes != "end":
                self.pop(line)
            self.pop(line)
        return at


def declarations(text: str, language: str) -> list[Chunk]:
    """Declarations of a text in one of LANGUAGES, in the order they begin; the
    parent is the innermost type around one.  What isn't closed ends with the
    text; unbalanced or broken text gives what there is up to there."""
    return _Lexer(text, language).run()
