"""Problem 9: personal information inside texts, found by a semi-Markov conditional random field.

Every span that may be a value is a segment: for names each stretch of 2 to 6 words within a run of
capitalised words, particles and initials; for numbers each stretch of groups of a run of digits; for
addresses each stretch of up to 6 words next to a house number; for emails each end of the domain and
each start of a spelled-out local part. A segment is scored as a whole, by features of its own and of
what stands beside it; neighbouring segments add a factor for their kinds and what lies between them.
Text outside of segments scores 0. Dynamic programming over (end, kind) gives the best reading, borders
and kinds chosen together, over all segments: those it leaves out beforehand have a score that no
neighbours could lift above 0. pii_train.py fits the weights.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import table
from corpusmix.shared import ship, spread

KINDS = ("email", "phone", "id", "address", "name")
WEIGHTS = Path(__file__).with_name("pii_weights.json")
#: Words of a name or of a street at most, words before a segment that count as its context, and entries of each cache.
NAME_WORDS, STREET_WORDS, CONTEXT, KEPT = 6, 6, 6, 1 << 16
#: Names that are broadcast at most.
LEXICON = 1 << 20

# Small words of English, German, French and Spanish, titles, particles of names, words before a flat's number.
FUNCTION = frozenset(
    "a an the and or but if of in on at to from by for with without as is are was were be been it its this that these those there here he she we they you i my your his her our their who what when where why how which while than then not no yes do does did can could will would should may might must have has had all any each every some most many few more less other another such only own same so too very just also after before between during under over above below about into through against until again once since because although though however past near both either neither nobody nothing someone everyone people most "
    "der die das den dem des ein eine einer eines einem einen und oder aber wenn weil dass ob im in am an auf zu zur zum von vom mit ohne nach vor bei aus für über unter durch gegen seit bis um ist sind war waren wird werden hat haben ich du er sie es wir ihr nicht kein keine keiner keines jede jeder jedes dieser diese dieses mein meine meinem meinen meiner dein deine sein seine unser unsere euer eure alle aller allen viele manche wenige einige wer was wann wo warum wie welche neben auch nur noch schon sehr "
    "le la les un une des du de et ou mais si dans sur sous avec sans pour par entre vers chez après avant depuis pendant est sont était qui que quoi quand où pourquoi comment ce cette ces son sa ses notre nos votre vos leur leurs il elle nous vous ils elles je tu on ne pas aucun aucune chaque tout toute tous selon "
    "el los las unos unas y o pero si en sobre con sin para por entre hacia desde hasta según durante es son era fue quien que cuando donde como cual este esta estos estas su sus nuestro nuestra cada todo toda todos ningún ninguna no".split()
)
TITLES = frozenset("mr mrs ms miss dr prof professor sir lady dame lord frau herr fräulein señor señora señorita sr sra don doña monsieur madame mademoiselle mme mlle m signor signora captain colonel judge president minister senator rabbi pastor father sister brother king queen saint st".split())
PARTICLES = frozenset("von van vom de der den du des del della di da dos das la le les lo ter ten zu zum zur af av bin ibn al el y e d st mac op".split())
FLATS = r"(?:flat|apt|apartment|unit|suite|ste|room|floor|whg|wohnung|piso|puerta|pta|appt|appartement|app|bte|interno|int)\.?|#"
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤"
LOW_STREETS = frozenset("rue avenue boulevard bd place quai impasse allée allee chemin route cours passage square via viale piazza corso largo calle c plaza camino avenida paseo ronda travesía carrera rua".split())

TLDS = frozenset("com org net edu gov mil int info biz io ai app dev eu de fr es it uk us ca au at ch nl be se no dk fi pl cz pt ie ru ua cn jp kr in br mx ar example test invalid localhost".split())

S = "[ \xa0]"
_letter = r"[^\W\d_]"
#: A word of a name: it begins with a capital, and may hold hyphens and apostrophes; or an initial.
CAPITAL = regex.compile(rf"(?<![\w@])(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.)*|\p{{Lu}}[\p{{L}}\p{{M}}]*(?:['’\-]\p{{L}}[\p{{L}}\p{{M}}]*)*)(?![\w@]|['’\-]\w)")
RUN = regex.compile(rf"{CAPITAL.pattern}(?:,?{S}(?:\p{{Ll}}{{1,5}}{S}|[dl]['’]){{0,3}}{CAPITAL.pattern})+")
PIECE = regex.compile(rf"(,)|({CAPITAL.pattern})|(\p{{Ll}}+)")
HAN = re.compile(rf"[{SURNAMES}][一-鿿]{{1,2}}")
#: The sign of an address, or the word between blanks or brackets.
AT = re.compile(r"[@ \xa0\[({<](?:(?<=@)|[aA][tT][ \xa0\])}>])")
DOT = rf"(?:\.|{S}?[\[({{<]{S}?(?i:dot){S}?[\])}}>]{S}?|{S}(?i:dot){S})"
LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
DOMAIN = re.compile(rf"{LABEL}(?:{DOT}{LABEL})+")
DOTS = re.compile(DOT)
SPELLED_LEFT = re.compile(rf"(?:[\w+'’-]+(?:{S}?[\[({{<]{S}?(?i:dot){S}?[\])}}>]{S}?|{S}(?i:dot){S}))+\Z")
NUMBERS = re.compile(r"(?<!\w)(?<!\d,)(?:[+(]{1,2}|(?:[A-Z]{1,2}[ \xa0])?(?=[A-Z]{0,3}\d))[A-Z]{0,3}\d[\dA-Z]*(?:[ \xa0./()-]{1,3}[A-Z]{0,3}\d[\dA-Z]*)*(?:[ \xa0-]?[A-Z](?![\w'’]))?")
GROUP = re.compile(r"[A-Z]{0,3}\d[\dA-Z]*|[A-Z]{1,2}")
LATER = re.compile(r"(?<=\d)\d")
HOUSE = re.compile(rf"(?<![\w/:€$£#+-])(?<!\d[.,])\d{{1,5}}(?:{S}?[a-zA-Z](?![\w'’]))?(?:[-/]\d{{1,4}}[a-zA-Z]?)?(?:{S}(?:bis|ter|quater)(?!\w))?(?![\w%€$£°]|[.,:/]\d|-\d)")
NUMBER_SIGN = re.compile(rf"(?:,?{S}(?:n\.?º|nº|núm\.|no\.|nr\.|Nr\.){S}?|,{S})\Z")
LOW_STREET = re.compile(rf"(?:{'|'.join(sorted(LOW_STREETS))})(?!\w)", re.I)
STREET_WORD = re.compile(rf"{_letter}(?:[\w'’]|[.](?=[\s,.]|\Z)|-(?=\w))*(?:/(?={S}))?")
FLAT = re.compile(rf",?{S}(?i:{FLATS}){S}?\d+{S}?[A-Za-zªº]?(?!\w)")
WORD = re.compile(r"[^\W_]+")
ABBREVIATED = frozenset("st rd ave av blvd str pl sq dr ln ct hwy nr no ste apt".split())
#: First digits of a group by class; the others are 9 in a shape, and the second is 8 in a run that begins with 00.
CLASSES = str.maketrans("123456789", "113336666")


class Lexicon:
    """What a list of names tells: the names themselves, and the usual endings of family names."""

    def __init__(self, names: Iterable[tuple[str | None, str | None]]):
        self.given: set[str] = set()
        self.family: set[str] = set()
        for kind, name in names:
            if kind and name and name.strip():
                (self.given if kind == "given" else self.family).add(name.strip().lower())
        count = Counter(n[-k:] for n in self.family for k in range(2, 7) if len(n) > k + 2)
        ends = set()
        for end in [e for e in count if len(e) == 2 and count[e] >= 3]:
            # An ending is lengthened as long as nine in ten names agree on the next letter.
            while (longer := max((e for e in count if len(e) == len(end) + 1 and e.endswith(end)), key=lambda e: (count[e], e), default=None)) and count[longer] >= 0.9 * count[end]:
                end = longer
            ends.add(end)
        self.ends = tuple(sorted(ends, key=lambda e: (-len(e), e)))
        self.share = {e: count[e] / max(1, len(self.family)) for e in self.ends}
        self.starts = {n[:2] for n in self.family}
        self.stems = {s[-2:] for n in self.family if (s := self.stem(n))}

    def stem(self, name: str) -> str:
        return next((name[: -len(e)] for e in self.ends if name.endswith(e) and len(name) > len(e) + 1), "")

    def like(self, word: str) -> str:
        """How much a word looks like the family names of the list."""
        if not (stem := self.stem(word)):
            return "no"
        return f"{'s' if stem[:2] in self.starts else '-'}{'e' if stem[-2:] in self.stems else '-'}{'' if len(stem) > 2 else '2'}{'+' if self.share[word[len(stem) :]] >= 0.04 else ''}"


class Segment:
    __slots__ = ("start", "end", "kind", "score", "features")

    def __init__(self, start: int, end: int, kind: str, score: float = 0.0, features: list[str] | None = None):
        self.start, self.end, self.kind, self.score, self.features = start, end, kind, score, features or []


class View:
    """A text, with what features ask of the whole of it, computed when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self._low: set[str] | None = None
        self._lines: dict[int, str] = {}
        self.edges: dict[tuple, tuple[float, list[str]]] = {}

    def lower(self, word: str) -> bool:
        """Whether the text has the word in small letters."""
        if self._low is None:
            self._low = {w for w in self.text.replace("\xa0", " ").split() if w[0].islower()} if len(self.text) < 512 else {w for w in set(self.text.split()) if w[0].islower()}
            self._low |= {w.rstrip(".,;:!?)") for w in self._low}
        return word in self._low

    def before(self, start: int) -> list[str]:
        """Up to CONTEXT words before a place on its line, the nearest first, in small letters."""
        low = self.text.rfind("\n", 0, start) + 1
        width = 64
        while True:
            at = max(low, start - width)
            found = WORD.findall(self.text[at:start])
            if at == low or len(found) > CONTEXT:
                return ["0" if w.isdigit() else w.lower() for w in found[: -CONTEXT - 1 : -1]]
            width *= 4

    def line(self, start: int) -> str:
        """Whether the line is set like a title: its words with a capital, over all."""
        low = self.text.rfind("\n", 0, start) + 1
        if low not in self._lines:
            high = self.text.find("\n", low)
            first = [w[0] for w in self.text[low : high if high >= 0 else len(self.text)].split()]
            n = sum(map(str.isalpha, first))
            up = sum(map(str.isupper, first))
            self._lines[low] = "few" if n < 5 else "title" if up >= 0.8 * n else "half" if up >= 0.5 * n else "text"
        return self._lines[low]

    def left(self, start: int) -> str:
        """What stands right before a place."""
        t = self.text
        if not start or t[start - 1] == "\n":
            return "^"
        c = t[start - 1]
        if c in " \xa0":
            p = t[start - 2] if start > 1 else "^"
            return "_^" if p in "^\n" else "_." if p in ".!?" else "_a" if p.isalpha() else "_0" if p.isdigit() else "_" + p
        return "a" if c.isalpha() else "0" if c.isdigit() else c

    def right(self, end: int) -> str:
        t = self.text
        if end >= len(t) or t[end] in "\r\n":
            return "^"
        c = t[end]
        if c in " \xa0":
            n = t[end + 1] if end + 1 < len(t) else "^"
            return "_A" if n.isupper() else "_a" if n.isalpha() else "_0" if n.isdigit() else "_" + n
        return "a" if c.isalpha() else "0" if c.isdigit() else c


def word_features(word: str, lexicon: Lexicon, role: str) -> list[str]:
    """Features of one word of a name. role: G for given, F for family, M between them."""
    low = word.lower()
    if word.endswith("."):
        return [f"{role}:initial"]
    parts = [p for p in re.split(r"-", low) if p]
    out = []
    for p in parts[:1] if role == "G" else parts[-1:]:
        known = ("g" if p in lexicon.given else "") + ("f" if p in lexicon.family else "")
        like = lexicon.like(p) if "f" not in known else "listed"
        out += [f"{role}:known={known or '-'}", f"{role}:like={like}", f"{role}:w={p}", f"{role}:s2={p[-2:]}", f"{role}:s3={p[-3:]}", f"{role}:p2={p[:2]}", f"{role}:len={min(len(p), 10)}"]
        if p in FUNCTION:
            out.append(f"{role}:function")
        if p in TITLES:
            out.append(f"{role}:title")
    out.append(f"{role}:shape={'X' if len(word) > 1 and word.isupper() else 'x' if word[0].islower() else 'm' if any(c.isupper() for c in word[1:]) and '-' not in word else 'C'}{'-' if len(parts) > 1 else ''}{'q' if chr(39) in word or '’' in word else ''}")
    if not word.isascii() and "CYRILLIC" in _script(word):
        out.append(f"{role}:cyrillic={p[-2:]}")
    return out


def _script(word: str) -> str:
    return "CYRILLIC" if any("Ѐ" <= c <= "ӿ" for c in word) else "LATIN"


def cased(words: list[str]) -> str:
    """The case of words, a sign for each."""
    return "".join("C" if w[0].isupper() else "0" if w[0].isdigit() else "c" for w in words)


class Model:
    """weights by feature. Without weights, proposals carry their features, for fitting."""

    def __init__(self, weights: dict[str, float] | None, lexicon: Lexicon):
        self.weights, self.lexicon = weights, lexicon
        self._words: dict[tuple[str, str], tuple[float, list[str]]] = {}
        self._runs: dict[str, list[tuple[int, int, str, float, list[str]]]] = {}
        self._signs: dict[str, tuple] = {}
        self._keys: dict[tuple, tuple[float, list[str]]] = {}
        self.least: dict[str, float] = {}
        self.lift: dict[str, float] = {}
        self.rests: dict[str, float] = {}
        self.rights: dict[str, float] = {}
        if weights is not None:
            # The most that what stands beside a segment can add: the best of each feature's values, and of CONTEXT words.
            best: dict[str, float] = {}
            for f, w in weights.items():
                head = f.split("=")[0]
                best[head] = max(best.get(head, 0.0), w)
            for k in KINDS:
                # No neighbours add more than this to a segment of the kind.
                self.lift[k] = sum(max([w for f, w in weights.items() if f.startswith("t:") and f.split(":")[1].split(">")[side] == k] + [0.0]) for side in (0, 1))
                beside = sum(w * (BAG[k] if h == f"{k}:bag" or h == f"{k}:kbag" else 1) for h, w in best.items() if h.startswith(f"{k}:") and h.split(":")[1] in BESIDE)
                self.least[k] = -beside - self.lift[k]
                self.rests[k] = sum(w for h, w in best.items() if h.startswith(f"{k}:") and h.split(":")[1] in ("low", "open"))
                self.rights[k] = sum(w for h, w in best.items() if h.startswith(f"{k}:") and h.split(":")[1] in ("r", "next", "cutr", "n1", "hr", "hr2"))
            self.steps = {f: w for f, w in weights.items() if f.startswith("t:")}

    def sum(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def keyed(self, key: tuple, make) -> tuple[float, list[str]]:
        """Score and features of what depends on the key alone."""
        got = self._keys.get(key)
        if got is None:
            features = make()
            got = (self.sum(features), []) if self.weights is not None else (0.0, features)
            if len(self._keys) >= KEPT:
                self._keys.clear()
            self._keys[key] = got
        return got

    def word(self, word: str, role: str) -> tuple[float, list[str]]:
        return self._keys.get((role, word)) or self.keyed((role, word), lambda: word_features(word, self.lexicon, role))

    def edge(self, view: View, key: tuple, make) -> tuple[float, list[str]]:
        """Score and features of what stands at one border, asked once for all segments that have it."""
        got = view.edges.get(key)
        if got is None:
            features = make()
            got = view.edges[key] = (self.sum(features), []) if self.weights is not None else (0.0, features)
        return got

    def add(self, view: View, out: list[Segment], start: int, end: int, kind: str, own: float, features: list[str], left, right, rest=None, way: str = "") -> None:
        """Keep a proposal, unless nothing beside it could make it worth while. left, right: features of what stands at
        each border, which depend on the place, the kind and way alone; rest: of both."""
        if self.weights is None:
            more = self.edge(view, (kind, way, start), left)[1] + self.edge(view, (kind, end), right)[1]
            out.append(Segment(start, end, kind, 0.0, features + more + (rest() if rest else [])))
        elif own > self.least[kind]:
            score = own + self.edge(view, (kind, way, start), left)[0]
            if score <= -self.rests[kind] - self.rights[kind] - self.lift[kind]:
                return
            score += self.edge(view, (kind, end), right)[0]
            if rest and score > -self.rests[kind] - self.lift[kind]:
                score += self.sum(rest())
            if score > -self.lift[kind]:
                out.append(Segment(start, end, kind, score))

    def segments(self, text: str) -> list[Segment]:
        """All segments that a text may hold."""
        out: list[Segment] = []
        view = View(text)
        self._emails(view, out)
        self._numbers(view, out)
        self._addresses(view, out)
        self._names(view, out)
        return out

    # --- each kind's segments

    def _emails(self, view: View, out: list[Segment]) -> None:
        text = view.text
        for a in AT.finditer(text):
            s, e = around(text, a.start(), a.end())
            m = DOMAIN.match(text, e) if s else None
            if not m:
                continue
            sign = text[s:e].strip()
            lo = s
            while lo and (text[lo - 1].isalnum() or text[lo - 1] in "._+-'’%"):
                lo -= 1
            while lo < s and text[lo] in "._+-'’%":
                lo += 1
            if lo == s or text[s - 1] in "._'’":
                continue
            starts = [lo]
            spelled = sign.lower() == "at" or sign[0] in "[({<"
            if spelled and (w := SPELLED_LEFT.search(text, text.rfind("\n", 0, lo) + 1, lo)):
                starts.append(w.start())
            form = "sign" if sign == "@" and e - s == 1 else "wide" if sign == "@" else "word" if sign.lower() == "at" else "bracket"
            ends = [d.start() for d in DOTS.finditer(text, m.start(), m.end())][1:] + [m.end()]
            for e in ends:
                value = text[m.start() : e]
                labels = [x for x in DOTS.split(value) if x]
                tld = labels[-1].lower()
                if not tld.isalpha() or len(tld) < 2:
                    continue
                dots = "plain" if "." in value else "spelled"
                rest = "end" if e == m.end() else "more"
                for b in starts:
                    local = text[b:s]
                    low = [p for p in re.split(r"[^^\W\d_]+", local.lower()) if len(p) > 1]
                    named = any(p in self.lexicon.given or p in self.lexicon.family or self.lexicon.stem(p) for p in low)
                    plain = local.isalpha()
                    f = [f"email:form={form}", f"email:dots={form}{dots}", f"email:rest={rest}", f"email:tld={tld if len(tld) < 8 else 'long'}", f"email:form={form}{dots}{'short' if len(tld) < 5 else 'long'}{rest}", f"email:known={form}{tld in TLDS}", f"email:named={form}{named}", f"email:plain={form}{plain}", f"email:spelled={b != lo}", f"email:start={len(starts)}{b == starts[-1]}"]
                    if plain and form == "word":
                        f.append(f"email:local={local.lower()}")
                        f.append(f"email:function={local.lower() in FUNCTION}")
                    self.add(view, out, b, e, "email", self.sum(f) if self.weights is not None else 0.0, f, lambda b=b: [f"email:l={view.left(b)}", *(f"email:bag={w}" for w in view.before(b)[: BAG["email"]])], lambda e=e: [f"email:r={view.right(e)}"])

    def _numbers(self, view: View, out: list[Segment]) -> None:
        text = view.text
        for m in NUMBERS.finditer(text):
            run = m.group()
            if len(run) < 7:
                continue
            shape = LATER.sub("9", run.translate(CLASSES))
            if run.startswith("00"):
                shape = "08" + shape[2:]
            got = self._runs.get(shape)
            if got is None:
                got = self._spans(shape)
                if len(self._runs) >= KEPT:
                    self._runs.clear()
                self._runs[shape] = got
            if not got:
                continue
            at = m.start()
            if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
                got = [g for g in got if g[1] < len(run)]
            for s, e, kind, own, f in got:
                s, e = at + s, at + e
                letters = "" if kind == "phone" else "d" if all(c.isdigit() for c in text[s:e] if c.isalnum()) else "a"
                self.add(view, out, s, e, kind, own, f, lambda s=s, kind=kind, letters=letters: self._before_number(view, s, kind, letters or "d"), lambda e=e, kind=kind: self._behind_number(view, e, kind), way=letters)

    @staticmethod
    def _before_number(view: View, s: int, kind: str, letters: str) -> list[str]:
        ws = view.before(s)
        t = view.text
        out = [f"{kind}:l={view.left(s)}", f"{kind}:w1={ws[0] if ws else '^'}"]
        out += [f"{kind}:bag={w}" for w in dict.fromkeys(ws)]
        out += [f"{kind}:kbag={letters}{w}" for w in dict.fromkeys(ws)]
        last, sign = t[s - 2 : s - 1] if s > 1 else "", t[s - 1 : s] if s else ""
        out.append(f"{kind}:prev={('.d' if sign in '.,/:-' else '_d' if sign == ' ' else 'no') if sign and '0' <= last <= '9' else 'no'}")
        return out

    @staticmethod
    def _behind_number(view: View, e: int, kind: str) -> list[str]:
        t = view.text
        sign, first = t[e : e + 1], t[e + 1 : e + 2]
        return [f"{kind}:r={view.right(e)}", f"{kind}:next={('.d' if sign in '.,/:-' else '_d' if sign == ' ' else 'no') if sign and '0' <= first <= '9' else 'no'}"]

    def _spans(self, shape: str) -> list[tuple[int, int, str, float, list[str]]]:
        """Stretches of groups of a run of numbers, given by the shape of the run, that may be a phone number or an id."""
        groups = [(g.start(), g.end()) for g in GROUP.finditer(shape)]
        out = []
        for i, (s0, _) in enumerate(groups):
            for j in range(i, len(groups)):
                e = groups[j][1]
                body = shape[s0:e]
                digits = sum(c.isdigit() for c in body)
                if digits > 18 or e - s0 > 40:
                    break
                if digits < 6:
                    continue
                letters = any(c.isalpha() for c in body)
                cut = f"{i > 0}{j < len(groups) - 1}"
                inner = [shape[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
                sizes = "-".join(str(b - a) for a, b in groups[i : j + 1])
                kinds = []
                if not letters and 7 <= digits <= 15:
                    for s in {s0, s0 - 1 if s0 and shape[s0 - 1] in "+(" else s0, s0 - 2 if s0 > 1 and shape[s0 - 2 : s0] in ("+(", "(+") else s0}:
                        v = shape[s:e]
                        if v.count("(") != v.count(")"):
                            continue
                        kinds.append(("phone", s, v))
                if not any(c in body for c in "()/"):
                    kinds.append(("id", s0, body))
                for kind, s, v in kinds:
                    head = re.match(r"[+(]*", v).group()
                    first = v[len(head)]
                    start = head + ("00" if v[len(head) + 1 : len(head) + 2] == "8" else first)
                    seps = "".join(sorted(set("".join(inner).replace("\xa0", " "))))
                    lead = "+" if s == s0 and s0 and shape[s0 - 1] == "+" else "(" if s == s0 and s0 and shape[s0 - 1] == "(" else ""
                    f = [
                        f"{kind}:cut={cut}", f"{kind}:lead={lead}", f"{kind}:start={start}", f"{kind}:digits={digits}", f"{kind}:groups={j - i + 1}", f"{kind}:seps={seps}", f"{kind}:sd={start}{digits}", f"{kind}:sizes={sizes}", f"{kind}:ss={start}{sizes}{seps}", f"{kind}:sg={start}{seps}{j - i + 1}{digits}",
                        f"{kind}:shape={re.sub('[0-9]', '9', v)}", f"{kind}:big={max(b - a for a, b in groups[i : j + 1])}", f"{kind}:small={min(b - a for a, b in groups[i : j + 1])}{j - i + 1}", f"{kind}:sc={start}{seps}",
                    ]
                    if kind == "id":
                        f.append(f"id:letters={letters}")
                        f.append(f"id:ends={'A' if v[0].isalpha() else '9'}{'A' if v[-1].isalpha() else '9'}")
                    out.append((s, e, kind, self.sum(f) if self.weights is not None else 0.0, f if self.weights is None else []))
        if self.weights is not None:
            out = [x for x in out if x[3] > self.least[x[2]]]
        return out

    def _street(self, words: tuple[str, ...], form: str, house: str, flat: bool) -> tuple[float, list[str]]:
        def make() -> list[str]:
            low = [w.lower().rstrip(".") for w in words]
            digits = sum(c.isdigit() for c in house)
            f = [f"address:form={form}", f"address:n={form}{len(words)}", f"address:case={form}{cased(list(words))}", f"address:digits={form}{digits}", f"address:house={form}{'x' if not house.isdigit() else '0' if house[0] == '0' else '9'}", f"address:flat={flat}"]
            f += [f"address:first={form}{low[0]}", f"address:last={form}{low[-1]}", f"address:s4={form}{low[-1][-4:]}", f"address:s6={form}{low[-1][-6:]}", f"address:s3={form}{low[-1][-3:]}", f"address:fl={form}{low[0] in FUNCTION}{low[-1] in FUNCTION}", f"address:small={form}{sum(w[0].islower() and x not in FUNCTION and x not in LOW_STREETS for w, x in zip(words, low))}", f"address:big={form}{sum(w[0].isupper() and x in FUNCTION for w, x in zip(words[1:], low[1:]))}"]
            if len(words) > 1:
                f += [f"address:two={form}{low[0]} {low[1]}" if low[0] in FUNCTION else f"address:sec={form}{low[1]}", f"address:in={form}{any(w in LOW_STREETS for w in low[1:-1])}", f"address:butlast={form}{low[-2]}", f"address:bs3={form}{low[-2][-3:]}"]
            return f

        digits = sum(c.isdigit() for c in house)
        return self.keyed(("street", words, form, f"{'0' if house[0] == '0' else '9'}{digits}{'' if house.isdigit() else 'x'}", flat), make)

    def _addresses(self, view: View, out: list[Segment]) -> None:
        text = view.text
        for h in HOUSE.finditer(text):
            s, e = h.span()
            back = s > 1 and text[s - 1] in " \xa0"
            if back:
                c = text[s - 2]
                if c.isalnum():
                    # The word before must have a capital or be one for a street.
                    p = text.rfind(" ", 0, s - 1) + 1
                    back = not text[p : s - 1].isalnum() or text[p].isupper() or text[p : s - 1].lower() in LOW_STREETS
                else:
                    back = c in ".º,'’/-"
            at = e + 1 if text[e : e + 1] != "," else e + 2
            if not back and not (text[at - 1 : at] in (" ", "\xa0") and (text[at : at + 1].isupper() or LOW_STREET.match(text, at))):
                continue
            house = h.group()
            # The number first: words behind it.
            at = e
            if at < len(text) and text[at] == ",":
                at += 1
            words: list[str] = []
            front = "front" if at == e else "front,"
            if at < len(text) and text[at] in " \xa0":
                at += 1
                while len(words) < STREET_WORDS and text[at : at + 1].isalpha() and (w := STREET_WORD.match(text, at)):
                    word = w.group()
                    stop = word.endswith(".") and word[:-1].lower() not in ABBREVIATED
                    if stop:
                        word = word[:-1]
                    if not words and not (word[0].isupper() or word.lower() in LOW_STREETS):
                        break
                    words.append(word)
                    end = w.start() + len(word)
                    if word[0].isupper() or word.lower() in LOW_STREETS:
                        self._address(view, out, s, end, tuple(words), front, house)
                    if stop or end >= len(text) or text[end] not in " \xa0":
                        break
                    at = end + 1
            # The number last: words before it.
            if not back:
                continue
            b = s - 1
            if text[b - 1] in "º.," and (gap := NUMBER_SIGN.search(text, max(0, s - 9), s)):
                b = gap.start()
            elif not (text[b - 1].isalnum() or text[b - 1] == "."):
                continue
            words = []
            while len(words) < STREET_WORDS and b > 0:
                p = max(text.rfind(" ", 0, b), text.rfind("\n", 0, b), 0)
                p += p > 0 or text[0] in " \n"
                if not text[p:b].isalnum():
                    p = b
                    while p and (text[p - 1].isalnum() or text[p - 1] in "'’-./"):
                        p -= 1
                word = text[p:b]
                if not words and word and not (word[0].isupper() or word.lower() in LOW_STREETS):
                    break
                if not word or not word[0].isalpha() or "." in word[:-1]:
                    break
                if words and word[-1] == "." and word[:-1].lower() not in ABBREVIATED | {"avda", "c", "pza", "ctra"}:
                    break
                words.insert(0, word)
                if word[0].isupper() or word.lower() in LOW_STREETS:
                    self._address(view, out, p, e, tuple(words), "back", house)
                if not p or text[p - 1] not in " \xa0":
                    break
                b = p - 1

    def _address(self, view: View, out: list[Segment], s: int, e: int, words: tuple[str, ...], form: str, house: str) -> None:
        text = view.text
        ends = [(e, False)]
        if m := FLAT.match(text, e):
            ends.append((m.end(), True))
        for end, flat in ends:
            own, f = self._street(words, form, house, flat)

            def left(s=s) -> list[str]:
                ws = view.before(s)
                return [f"address:l={view.left(s)}", f"address:w1={ws[0] if ws else '^'}", *(f"address:bag={w}" for w in dict.fromkeys(ws[: BAG["address"]])), f"address:line={view.line(s)}"]

            self.add(view, out, s, end, "address", own, f, left, lambda end=end: [f"address:r={view.right(end)}"], lambda flat=flat: [f"address:open={len(ends) > 1 and not flat}", f"address:low={form}{view.lower(words[-1].lower())}"])

    def _names(self, view: View, out: list[Segment]) -> None:
        text = view.text
        for m in RUN.finditer(text):
            pieces = [(p.start(), p.end(), p.lastindex) for p in PIECE.finditer(text, m.start(), m.end())]
            n = len(pieces)
            for i in range(n):
                if pieces[i][2] == 1 or (pieces[i][2] == 3 and text[pieces[i][0] : pieces[i][1]] not in PARTICLES):
                    continue
                words = 0
                comma = -1
                for j in range(i, n):
                    s, e, what = pieces[j]
                    if what == 1:
                        if comma >= 0 or j == i:
                            break
                        comma = j
                        continue
                    words += 1
                    if words > NAME_WORDS:
                        break
                    if what == 3 and text[s:e] not in PARTICLES:
                        break
                    if what == 2 and words > 1:
                        self._name(view, out, pieces[i : j + 1], comma - i if comma >= 0 else -1)
        if "一" <= max(text, default="") and not text.isascii():
            for m in HAN.finditer(text):
                for e in range(m.start() + 2, m.end() + 1):
                    f = [f"name:han={e - m.start()}"]
                    b = text[max(0, m.start() - 2) : m.start()]
                    self.add(view, out, m.start(), e, "name", self.sum(f) if self.weights is not None else 0.0, f, lambda b=b: [f"name:hl2={b}", f"name:hl={b[-1:]}"], lambda e=e: [f"name:hr={text[e : e + 1]}", f"name:hr2={text[e : e + 2]}"], way="han")

    def _name(self, view: View, out: list[Segment], pieces: list[tuple[int, int, int]], comma: int) -> None:
        text = view.text
        start, end = pieces[0][0], pieces[-1][1]
        words = [text[s:e] for s, e, k in pieces if k != 1]
        told = [self._told(w) for w in words]
        signs = "".join([t[0] for t in told])
        real = len(signs) - signs.count("p") - signs.count("I")
        if real < 2 and not (real == 1 and signs[0] == "I"):
            return
        first, last = words[0], words[-1]
        if comma >= 0:
            # Family name first: the words up to the comma, then given names.
            order, f, g = "comma", comma - 1, comma
        else:
            # Or where the list says so.
            turned = signs[-1] != "I" and (told[-1][3] or told[0][4]) and not told[0][3] and (told[0][4] or told[0][5])
            order, f, g = ("family", 0, len(words) - 1) if turned else ("given", len(words) - 1, 0)
        pattern = signs
        score, features = self.keyed(("name", order, pattern), lambda: [f"name:order={order}", f"name:pattern={order}{pattern}", f"name:caps={order}{'no' if 'X' not in pattern else 'some' if 'C' in pattern else 'all'}"])
        features = list(features)
        known = ""
        for k, w in enumerate(words):
            role = "F" if k == f else "G" if k == g else "M"
            x, more = self.word(w, role)
            score += x
            if more:
                features += more
            if role != "M":
                known += role + told[k][1 if role == "G" else 2]
        x, more = self.keyed(("known", order, known), lambda: [f"name:known={order}{known}"])
        score += x
        features += more

        self.add(view, out, start, end, "name", score, features, lambda: self._before_name(view, start), lambda: self._behind_name(view, end), lambda: [f"name:low={order}{view.lower(first.lower())}{view.lower(last.lower())}"])

    def _before_name(self, view: View, start: int) -> list[str]:
        text = view.text
        ws = view.before(start)
        left = view.left(start)
        out = [f"name:l={left}", f"name:w1={ws[0] if ws else '^'}", f"name:line={view.line(start)}"]
        out += [f"name:bag={w}" for w in dict.fromkeys(ws[: BAG["name"]])]
        cut = "no"
        if left == "_a" or left == "_.":
            p = start - 2
            while p >= 0 and (text[p].isalnum() or text[p] in "'’-."):
                p -= 1
            w = text[p + 1 : start - 1]
            if w and w[0].isupper():
                k = w.rstrip(".").lower()
                cut = "title" if k in TITLES else "function" if k in FUNCTION else "given" if k in self.lexicon.given else "cap" if left == "_a" else "stop"
            elif w.lower() in PARTICLES:
                cut = "particle"
        out.append(f"name:cutl={cut}")
        return out

    def _behind_name(self, view: View, end: int) -> list[str]:
        text = view.text
        right = view.right(end)
        cut = "no"
        if right == "_A":
            p = end + 1
            while p < len(text) and (text[p].isalnum() or text[p] in "'’-"):
                p += 1
            k = text[end + 1 : p].lower()
            cut = "initial" if p - end == 2 and text[p : p + 1] == "." else "function" if k in FUNCTION else "family" if k in self.lexicon.family or self.lexicon.stem(k) else "cap"
        elif right == "_a":
            p = end + 1
            while p < len(text) and text[p].isalnum():
                p += 1
            cut = "particle" if text[end + 1 : p] in PARTICLES else "no"
        n = WORD.match(text, end + 1) if right in ("_a", "_A") else None
        return [f"name:r={right}", f"name:cutr={cut}", f"name:n1={n.group().lower() if n else right}"]

    def _told(self, word: str) -> tuple[str, str, str, bool, bool, bool]:
        """A sign for the word's form; what the lists say of it as a given and as a family name; whether it is listed as
        either, or ends like those listed."""
        got = self._signs.get(word)
        if got is None:
            lex, low = self.lexicon, word.lower()
            parts = low.split("-")
            says = [("g" if p in lex.given else "") + ("f" if p in lex.family or lex.stem(p) else "") + ("u" if p in FUNCTION else "") for p in (parts[0], parts[-1])]
            sign = "p" if word in PARTICLES else "I" if word.endswith(".") else "X" if word.isupper() and len(word) > 1 else "C"
            if len(self._signs) >= KEPT:
                self._signs.clear()
            got = self._signs[word] = (sign, *says, low in lex.given, low in lex.family, bool(lex.stem(low)))
        return got

    # --- reading

    def step(self, text: str, a: Segment, b: Segment) -> str:
        """The feature of two segments with no word between them."""
        gap = text[a.end : b.start]
        return f"t:{a.kind}>{b.kind}:{'n' if chr(10) in gap else ',' if ',' in gap else 'o' if gap.strip() else '_'}"

    def read(self, text: str | None) -> list[Segment]:
        """The segments, without overlap, whose scores and factors between neighbours add up to the most."""
        if not text:
            return []
        found = self.segments(text)
        if not found:
            return []
        found.sort(key=lambda s: (s.end, s.start, s.kind))
        ends = [s.end for s in found]
        # total[i]: the best reading that ends with segment i; upto[i]: the best of all before i, and which.
        total: list[float] = []
        back: list[int] = []
        upto: list[tuple[float, int]] = [(0.0, -1)]
        for i, s in enumerate(found):
            near = adjacent(text, s.start)
            k = bisect.bisect_left(ends, near, 0, i)
            best, via = upto[k]
            for j in range(k, bisect.bisect_right(ends, s.start, k, i)):
                x = total[j] + self.steps.get(self.step(text, found[j], s), 0.0)
                if x > best:
                    best, via = x, j
            total.append(best + s.score)
            back.append(via)
            upto.append(max(upto[-1], (total[i], i), key=lambda t: t[0]))
        out, i = [], upto[-1][1]
        while i >= 0:
            out.append(found[i])
            i = back[i]
        return out[::-1]


#: Words before a segment of each kind that count.
BAG = {"email": 2, "phone": CONTEXT, "id": CONTEXT, "address": 4, "name": 3}
#: Features of what stands beside a segment.
BESIDE = frozenset("n1 l r w1 bag kbag next prev line open low cutl cutr hl hl2 hr hr2".split())


def around(text: str, s: int, e: int) -> tuple[int, int]:
    """Where the sign of an address begins and ends, with its blanks and brackets; 0, 0 if it is none."""
    n = len(text)
    if e - s == 1:
        return (s - 1, e + 1) if 0 < s and e < n and text[s - 1] in " \xa0" and text[e] in " \xa0" else (s, e)
    if text[s] in " \xa0" and s and text[s - 1] in "[({<":
        s -= 1
    if text[e - 1] in " \xa0" and e < n and text[e] in "])}>":
        e += 1
    opened, shut = text[s] in "[({<", text[e - 1] in "])}>"
    if opened != shut:
        return 0, 0
    if opened:
        s -= s > 0 and text[s - 1] in " \xa0"
        e += e < n and text[e] in " \xa0"
    return s, e


def adjacent(text: str, start: int) -> int:
    """Where a segment ends at least, for no word to stand between it and start."""
    while start and not text[start - 1].isalnum():
        start -= 1
    return start


#: The broadcast and the model of a worker process, which keeps its caches from task to task.
_models: list = []


def find(documents: DataFrame, names: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, redacted, found (array of kind, value, start): one row per document.

    redacted: the text with [EMAIL], [PHONE], [ID], [ADDRESS] or [NAME] in the place of each finding
    and otherwise unchanged; null for a null text. found: in the order of the text, start in
    characters from 0; empty where there is nothing. Bytes that aren't UTF-8 count as U+FFFD. names:
    name_type (given, family), name; nulls are ignored; at most LEXICON distinct rows, which are
    broadcast, ValueError beyond. Repeated rows each count; other columns are ignored; an empty table
    gives no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    listed = [(r[0], r[1]) for r in names.select("name_type", "name").distinct().limit(LEXICON + 1).collect()]
    if len(listed) > LEXICON:
        raise ValueError(f"more than {LEXICON} names")
    weights = weights if weights is not None else json.loads(WEIGHTS.read_text())
    shared = spark.sparkContext.broadcast((weights, listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not (_models[0] if _models else None):
            _models[:] = [shared.value, Model(shared.value[0], Lexicon(shared.value[1]))]
        model = _models[1]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32())]))
        for b in batches:
            texts, found = [], []
            for text in b.column(1):
                text = text.as_py()
                segs = model.read(text)
                found.append([{"kind": s.kind, "value": text[s.start : s.end], "start": s.start} for s in segs])
                if segs:
                    parts, at = [], 0
                    for s in segs:
                        parts += [text[at : s.start], f"[{s.kind.upper()}]"]
                        at = s.end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, kind)], ["doc_id", "redacted", "found"])

    rows = documents.select("doc_id", F.expr("make_valid_utf8(text)").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"doc_id {kind}, redacted string, found array<struct<kind: string, value: string, start: int>>")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.value").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon")).select("doc_id", F.col("redacted").alias("text"))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
