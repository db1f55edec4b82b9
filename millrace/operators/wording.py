"""Reads an answer's prose: sentences, citations, terms of a plant, relations that are asserted, and claims in blocks.

What must hold, in our words:

- A text is a row of tokens: words and names (with the `-`, `.`, `/` and apostrophes inside them), brackets, and single marks.
- A bracket cites if all its parts are `E<step>.<row>` or `R<step>`; it is a broken citation if it merely tries to.
- A sentence ends at a full stop, question or exclamation mark before white space, a bracket or the end, and at a line's end. Citations right behind
  the mark belong to the sentence before. A line of citations alone belongs to all sentences above it that have none, back to the last that has some.
- A term is something that a result must back: a number with a unit, a nominal diameter, a name of letters and digits, a class name, a number of
  three digits or with a decimal point.
- A clause ends at a comma, semicolon, colon, parenthesis, free dash, or a word that turns the sentence. A denial takes back the rest of its
  clause; a clause that gives somebody else's words, or supposes something, is taken back whole. What is taken back is not asserted.
- A verb of VERBS states a relation. Its object and preposition may decide which; a participle before `by` or `from` turns it round.

Reading is done once per text, by a small scan over tokens; whatever is compared with facts is rows and joins elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from millrace.functions import text as tx

UNITS = frozenset("m3/h m³/h kg/h l/min min-1 mbar barg bar kPa MPa Pa psi °C °F kW MW m2 m² m3 m³ mm cm km rpm kg % m".split())

#: Verbs: base form, other forms where they are irregular, what it does to whom (object, preposition) -> relation. An object of "" stands for none, a
#: preposition of "" for none needed. flow: the first feeds the second; links have the names of facts.
FLUID, MEASURED, SIGNAL = "fluid", "measurement", "signal"
VERBS: dict[str, dict[tuple[str, str], str]] = {
    "feed": {("", ""): "flow", (MEASURED, "to"): "measurement_input_to"},
    "supply": {("", ""): "flow"},
    "discharge": {("", ""): "flow", ("", "to"): "flow", ("", "into"): "flow"},
    "deliver": {("", ""): "flow", ("", "to"): "flow", (FLUID, "to"): "flow"},
    "flow": {("", "to"): "flow", ("", "into"): "flow"},
    "send": {(FLUID, "to"): "flow", (SIGNAL, "to"): "sends_signal_to", (MEASURED, "to"): "measurement_input_to"},
    "pass": {(MEASURED, "to"): "measurement_input_to", (FLUID, "to"): "flow", (SIGNAL, "to"): "sends_signal_to"},
    "receive": {(FLUID, "from"): "fed", ("", "from"): "fed"},
    "operate": {("", ""): "operates"},
    "actuate": {("", ""): "operates"},
    "act": {("", "on"): "operates"},
    "control": {("", ""): "operates"},
    "signal": {("", "to"): "sends_signal_to"},
    "transmit": {("", "to"): "sends_signal_to", (SIGNAL, "to"): "sends_signal_to"},
    "sense": {("", ""): "senses_at", ("", "at"): "senses_at"},
    "measure": {("", "at"): "senses_at"},
    "take": {(MEASURED, "at"): "senses_at"},
}
IRREGULAR = {"feed": ("fed", "fed"), "send": ("sent", "sent"), "take": ("took", "taken")}
#: Base forms that are rather nouns or adjectives: only their other forms state something.
NOT_AS_BASE = frozenset({"control", "signal", "act", "measure", "take", "pass", "flow", "supply", "discharge"})
OBJECTS = {FLUID: {"fluid", "flow", "feed", "product", "medium", "liquid", "gas"}, SIGNAL: {"signal", "signals", "output", "outputs"}, MEASURED: {"measurement", "measurements", "reading", "readings"}}
FILLERS = frozenset({"a", "an", "the", "its", "their", "this", "that", "on", "process", "any", "all"})
#: Words that relate what a sentence names, whatever they say in particular; and those that leave no room for anything between.
RELATING = ("connect", "link", "join", "attach", "fed", "feed", "discharg", "suppl", "deliver", "flow", "lead", "rout", "path", "between", "downstream", "upstream", "reach")
DIRECT = frozenset({"directly", "immediately", "adjacent"})
TURNING = frozenset({"but", "however", "whereas", "while", "although", "though"})
DENIAL = frozenset({"not", "no", "never", "nor", "neither", "cannot", "without"})
TELLING = frozenset({"said", "say", "stated", "mentioned", "asked", "wrote", "assumed", "suggested", "claimed"})
SUPPOSED = ("assum", "hypothe", "unverified", "unconfirmed", "suppos")
YOURS = frozenset({"assumption", "premise", "question", "statement", "claim"})
#: Words that own up to not knowing, besides denials.
DOUBT = ("unable", "unverified", "unconfirmed", "hypothe", "assum", "suggest", "similar", "candidate", "instead", "absent", "missing", "unknown", "suppos", "unclear")
#: Words of plants, and of what things are for: a sentence with one of them says something about the plant.
PLANT = frozenset(
    "pump compressor exchanger tank vessel column reactor drum heater cooler filter separator valve line pipe piping nozzle chamber flange tee reducer fitting connector equipment instrument transmitter controller sensor actuator loop signal "
    "main primary principal purpose serve responsible designed intended role duty".split()
)
USES = frozenset({"for", "to", "as"})
#: Words for a state that changes while a plant runs; a drawing never holds it.
STATES = frozenset("open opened closed shut running stopped off active inactive idle tripped energized full empty leaking blocked".split())
NOW = (("currently",), ("right", "now"), ("at", "the", "moment"), ("at", "present"))
BE = frozenset({"is", "are", "was", "were", "be", "stays", "remains", "stands"})
ADVERBS = frozenset({"now", "currently", "fully", "partly", "still", "already", "normally", "presently"})
#: Words before a name that say as what it is meant.
ROLES = ("line", "segment", "component", "nozzle", "chamber", "connection")
COUNTED = frozenset({"number", "no", "no."})
SIDE_REACH = 80

_FOLD = str.maketrans(*tx.TYPOGRAPHY)
_TOKEN = re.compile(r"\[[^\[\]\n]*\]|[\w⁰-₟]+(?:['’./-][\w⁰-₟]+)*|->|→|\n|[^\S\n]+|.", re.S)
_REF = re.compile(r"E\d+\.\d+|R\d+")
_TRIES = re.compile(r"\s*(?:[ER]\s?\d|ref|evidence|row|result)", re.I)
_END = ".!?"


def _forms() -> dict[str, tuple[str, bool]]:
    """Form -> (base, whether it is a participle)."""
    out: dict[str, tuple[str, bool]] = {}
    for base in VERBS:
        stem = base[:-1] if base.endswith("e") else base
        double = stem + stem[-1] if base in ("control", "transmit") else stem
        third = base[:-1] + "ies" if base.endswith("y") else base + ("es" if base.endswith("ss") else "s")
        past, participle = IRREGULAR.get(base, (base[:-1] + "ied" if base.endswith("y") else double + "ed",) * 2)
        for form in (third, double + "ing", *([] if base in NOT_AS_BASE else [base])):
            out[form] = (base, False)
        out[past] = (base, past == participle)
        out[participle] = (base, True)
        for form in (past, participle):
            if base == "signal":
                out["signalled"] = (base, True)
    return out


FORMS = _forms()


@dataclass
class Token:
    text: str
    at: int
    low: str = field(init=False)

    def __post_init__(self):
        self.low = self.text.lower()

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def is_word(self) -> bool:
        return self.text[0].isalnum() or self.text[0] == "_"


@dataclass
class Term:
    term: str
    kind: str
    at: int
    asserted: bool = True
    minus: bool = False  # a dash stands before it


@dataclass
class Relation:
    kind: str
    start: int
    end: int
    passive: bool


@dataclass
class Sentence:
    text: str
    refs: list[str]
    broken: list[str]
    terms: list[Term]
    relations: list[Relation]
    roles: list[tuple[str, str]]
    words: list[str]
    related: bool
    direct: bool
    doubts: bool
    about_plant: bool
    live: str | None


def tokens_of(text: str) -> list[Token]:
    """Tokens with their places, white space left out but for line ends."""
    return [Token(m.group(), m.start()) for m in _TOKEN.finditer(text) if not m.group().isspace() or m.group() == "\n"]


def cited(bracket: str) -> list[str] | None:
    """The references of a bracket; None if it cites nothing."""
    parts = [p.strip() for p in re.split("[,;]", bracket[1:-1])]
    return parts if all(_REF.fullmatch(p) for p in parts) else None


def sentences_of(prose: str) -> list[str]:
    """Sentences and list items, each with the citations that belong to it."""
    text = prose.translate(_FOLD)
    found: list[tuple[str, list[str]]] = []  # body, citations
    body, refs, mark = "", [], ""  # of the sentence that is being read

    def close():
        nonlocal body, refs, mark
        plain = body.strip()
        if plain.strip(".:;-*! ?"):
            if refs and found and found[-1][0].endswith(":") and not found[-1][1]:
                found[-1] = (found[-1][0], list(refs))  # a line that leads in
            found.append((plain + (f" {' '.join(refs)}" if refs else "") + mark, refs))
        elif refs:
            k = len(found)
            while k and not found[k - 1][1]:
                k -= 1
            for i in range(k, len(found)):
                found[i] = (f"{found[i][0]} {' '.join(refs)}", list(refs))
            if k == len(found):
                found.append((" ".join(refs), refs))
        body, refs, mark = "", [], ""

    pieces = [m.group() for m in _TOKEN.finditer(text)]
    # Whether nothing but citations and marks follows up to the sentence's end.
    last = [True] * (len(pieces) + 1)
    for i in range(len(pieces) - 1, -1, -1):
        p = pieces[i]
        last[i] = p == "\n" or p in _END or ((p.isspace() or bool(p[0] == "[" and cited(p))) and last[i + 1])
    for i, piece in enumerate(pieces):
        if piece == "\n":
            close()
        elif piece[0] == "[" and cited(piece):
            if mark or not body.strip() or last[i + 1]:
                refs.append(piece)
            else:
                body += piece
        elif piece.isspace():
            body += "" if mark else piece
        else:
            if mark:
                close()
            if piece in _END and (i + 1 == len(pieces) or pieces[i + 1].isspace() or pieces[i + 1][0] == "["):
                mark = piece
            else:
                body += piece
    close()
    return [_led(s, r) for s, r in found]


def _led(body: str, refs: list[str]) -> str:
    return f"{body} {' '.join(refs)}" if body.endswith(":") and refs else body


def _numeric(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return text[0].isdigit()


def _term(tokens: list[Token], i: int, source: str) -> tuple[Term, int] | None:
    """The term that begins at token i, and the number of tokens that it takes."""
    t = tokens[i]
    if not t.is_word:
        return None
    following = tokens[i + 1] if i + 1 < len(tokens) else None
    minus = i > 0 and tokens[i - 1].text == "-"
    digits = re.match(r"\d+(?:\.\d+)?", t.text)
    if digits and (unit := t.text[digits.end() :]) in UNITS:
        return Term(t.text, "value_with_unit", t.at, minus=minus), 1
    if _numeric(t.text):
        if following and following.text == "°" and i + 2 < len(tokens) and f"°{tokens[i + 2].text}" in UNITS:
            return Term(source[t.at : tokens[i + 2].end], "value_with_unit", t.at, minus=minus), 3
        if following and following.text in UNITS:
            return Term(source[t.at : following.end], "value_with_unit", t.at, minus=minus), 2
    if t.low == "dn" and following and following.text.isdigit():
        return Term(source[t.at : following.end], "nominal_diameter", t.at), 2
    if re.fullmatch(r"dn\d+", t.low):
        return Term(t.text, "nominal_diameter", t.at), 1
    has_digit, has_letter = any(c.isdigit() for c in t.text), any(c.isalpha() for c in t.text)
    if has_digit and has_letter:
        return None if re.fullmatch(r"\d+(st|nd|rd|th)", t.low) else (Term(t.text, "identifier", t.at), 1)
    if t.text.isalpha() and t.text[0].isupper() and re.search("[a-z][A-Z][a-z]", t.text):
        return Term(t.text, "type_name", t.at), 1
    if _numeric(t.text) and ("." in t.text or len(t.text) >= 3):
        return Term(t.text, "number", t.at, minus=minus), 1
    return None


def terms_of(sentence: str) -> list[Term]:
    tokens, out, i = tokens_of(sentence.translate(_FOLD)), [], 0
    while i < len(tokens):
        if found := _term(tokens, i, sentence):
            out.append(found[0])
        i += found[1] if found else 1
    return out


def taken_back(tokens: list[Token]) -> list[bool]:
    """For each token, whether the sentence doesn't assert it."""
    out, start = [False] * len(tokens), 0
    for i in range(len(tokens) + 1):
        t = tokens[i] if i < len(tokens) else None
        dash = t is not None and t.text == "-" and i > 0 and tokens[i - 1].end < t.at and i + 1 < len(tokens) and t.end < tokens[i + 1].at
        if t is None or t.text in ",;:()" or dash or t.low in TURNING:
            clause = tokens[start:i]
            low = [x.low for x in clause]
            told = any(a in ("you", "user") and b in TELLING or a == "your" and b in YOURS or (a, b) == ("you", "mean") for a, b in zip(low, low[1:], strict=False)) or any(x.startswith(SUPPOSED) for x in low)
            denied = next((k for k, x in enumerate(low) if x in DENIAL or x.endswith(("n't", "n’t")) or low[k : k + 2] in (["rather", "than"], ["instead", "of"])), len(clause))
            for k in range(0 if told else denied, len(clause)):
                out[start + k] = True
            start = i + 1
    return out


def _object(tokens: list[Token], i: int) -> tuple[str, str, int]:
    """What a verb at i - 1 does to what: its object (or ""), its preposition (or ""), and the token behind both."""
    k = i
    while k < len(tokens) and tokens[k].low in FILLERS and k < i + 3:
        k += 1
    kind = next((name for name, words in OBJECTS.items() if k < len(tokens) and tokens[k].low in words), "")
    after = k + 1 if kind else i
    while kind and after < len(tokens) and tokens[after].low in ("on",):
        after += 1
    preposition = tokens[after].low if after < len(tokens) and tokens[after].low in ("to", "into", "from", "at", "on", "by") else ""
    return kind, preposition, after + bool(preposition)


def relations_of(tokens: list[Token], back: list[bool]) -> list[Relation]:
    out, i = [], 0
    while i < len(tokens):
        t, nxt = tokens[i], i + 1
        if back[i]:
            pass
        elif t.low in ("downstream", "upstream") and nxt < len(tokens) and tokens[nxt].low in ("of", "from"):
            out.append(Relation(t.low, t.at, tokens[nxt].end, False))
            nxt += 1
        elif t.low in FORMS:
            base, participle = FORMS[t.low]
            kind, preposition, after = _object(tokens, nxt)
            passive = participle and preposition in ("by", "from")
            by = VERBS[base]
            relation = by.get(("", "")) or next(iter(by.values())) if passive else by.get((kind, preposition)) or (by.get(("", preposition)) if not kind else None) or (by.get(("", "")) if not kind else None)
            if relation == "flow" and passive:
                relation = "fed"
            if relation:
                end = tokens[after - 1].end if passive or (kind, preposition) in by or preposition and ("", preposition) in by else t.end
                out.append(Relation(relation, t.at, end, passive))
                nxt = max(nxt, after) if end > t.end else nxt
        i = nxt
    return out


def _live(tokens: list[Token], back: list[bool]) -> str | None:
    """Words that claim to know the plant's present state."""
    for i, t in enumerate(tokens):
        if back[i]:
            continue
        for words in NOW:
            if [x.low for x in tokens[i : i + len(words)]] == list(words):
                return " ".join(words)
        if t.low in BE or t.low.endswith(("'s", "’s")) and t.low not in ("its",):
            k = i + 1
            while k < len(tokens) and tokens[k].low in ADVERBS:
                k += 1
            if k < len(tokens) and tokens[k].low in STATES and not back[k] and not (k + 1 < len(tokens) and tokens[k + 1].low in ("end", "ends", "ended", "by", "at")):
                return f"{t.low} {tokens[k].low}"
    return None


def _roles(tokens: list[Token]) -> list[tuple[str, str]]:
    """(word, name) where a word says as what the name behind it is meant."""
    out = []
    for i, t in enumerate(tokens):
        word = t.low[:-1] if t.low.endswith("s") and t.low[:-1] in (*ROLES, *PLANT) else t.low
        if word in ROLES or word in PLANT:
            k = i + 1
            while k < len(tokens) and (tokens[k].low in COUNTED or tokens[k].text in "#*`_"):
                k += 1
            if k < len(tokens) and tokens[k].is_word and any(c.isdigit() for c in tokens[k].text):
                out.append((word, tokens[k].text))
    return out


def read_sentence(raw: str) -> Sentence:
    source = raw.translate(_FOLD)
    refs, broken = [], []
    for m in re.finditer(r"\[[^\[\]\n]*\]", source):
        found = cited(m.group())
        if found:
            refs = list(dict.fromkeys([*refs, *found]))
        elif _TRIES.match(m.group()[1:]):
            broken.append(m.group())
        if found or m.group() in broken:
            source = source[: m.start()] + " " * len(m.group()) + source[m.end() :]
    tokens = tokens_of(source)
    back = taken_back(tokens)
    terms, covered, i = [], [False] * len(tokens), 0
    while i < len(tokens):
        found = _term(tokens, i, source)
        if found:
            found[0].asserted = not back[i]
            terms.append(found[0])
            covered[i : i + found[1]] = [True] * found[1]
        i += found[1] if found else 1
    words = [t.low for t in tokens if t.is_word]
    plain = [t for t, c in zip(tokens, covered, strict=True) if not c]
    plain_back = [b for b, c in zip(back, covered, strict=True) if not c]
    relations = relations_of(plain, plain_back)
    said = [t.low for t, b in zip(plain, plain_back, strict=True) if not b]
    related = bool(relations) or any(w.startswith(RELATING) or w in ("→", "->") for w in said)
    singular = {w[:-1] if w.endswith("s") else w for w in said} | set(said)
    about = bool(singular & PLANT) or any(a == "used" and b in USES for a, b in zip(said, said[1:], strict=False))
    doubts = any(w in DENIAL or w.endswith(("n't", "n’t")) or w.startswith(DOUBT) or w in ("if", "your") for w in words) or any(a == "you" and b in TELLING for a, b in zip(words, words[1:], strict=False)) or "did you mean" in " ".join(words)
    text = " ".join(source.split())
    return Sentence(text, refs, broken, terms, relations, _roles(tokens), words, related, bool(DIRECT & set(said)), doubts, about, _live(tokens, back))


def read(prose: str | None) -> Iterator[Sentence]:
    return map(read_sentence, sentences_of(prose or ""))


def split_answer(answer: str | None) -> tuple[str, list | None]:
    """The prose of an answer, and the claims of its last block that can be read; None if there is none.

    A block stands between fence lines (three or more backticks), the first of which may say claims or json. A block that says claims and can't be read, or never ends, goes
    too. So does a heading of the word claims right above the place.
    """
    kept: list[str] = []
    blocks: list[tuple[int, str, list[str], bool]] = []  # line where it stood, what its fence says, lines, whether it was closed
    inside: list[str] | None = None
    for line in (answer or "").split("\n"):
        mark = line.strip()
        if mark.startswith("```"):
            if inside is None:
                inside, named = [], mark.strip("`").strip().lower()
                blocks.append((len(kept), named, inside, False))
            else:
                blocks[-1] = (*blocks[-1][:3], True)
                inside = None
        elif inside is None:
            kept.append(line)
        else:
            inside.append(line)
    taken = None
    claims: list | None = None
    for n in reversed(range(len(blocks))):
        at, named, lines, closed = blocks[n]
        if closed and named in ("", "json", "claims") and (claims := claims_of("\n".join(lines))) is not None:
            taken = n
            break
    out: list[str] = []
    for k in range(len(kept) + 1):
        for n, (at, named, lines, closed) in enumerate(blocks):
            if at == k and (n == taken or named == "claims" and taken is None):
                while out and not out[-1].strip():
                    out.pop()
                if out and re.sub(r"[#*:\s]", "", out[-1]).lower() in ("claims", "structuredclaims"):
                    out.pop()
            elif at == k:
                out += [f"```{named}", *lines, *(["```"] if closed else [])]
        out += kept[k : k + 1]
    return "\n".join(out).strip(), claims


def claims_of(body: str) -> list | None:
    """Claims as a JSON list, as an object that has one, or one or a list on each line."""
    decoder = json.JSONDecoder()
    try:
        whole, end = decoder.raw_decode(body.strip())
    except ValueError:
        whole, end = None, -1
    if end == len(body.strip()):
        if isinstance(whole, dict) and "claims" in whole:
            whole = whole["claims"]
        if isinstance(whole, list) or not isinstance(whole, dict):
            return whole if isinstance(whole, list) else None
        return [whole] if "predicate" in whole else None
    out: list = []
    for line in filter(None, (x.strip().rstrip(",") for x in body.split("\n"))):
        try:
            one = json.loads(line)
        except ValueError:
            return None
        out += one if isinstance(one, list) else [one]
    return out
