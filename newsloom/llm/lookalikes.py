"""Characters that look alike, and the automaton that reads words through them."""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import regex

#: Letters of other scripts, and unusual Latin letters, with the plain
#: letters they look like (the first is the usual one).  Lower-case forms that arise by
#: lower-casing a look-alike capital stand here too.
LOOKS_LIKE: dict[str, str] = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ԍ": "g", "г": "r", "п": "n", "ь": "b",
    "ӕ": "æ", "ө": "ø", "ё": "ë", "ї": "ï", "ӓ": "ä", "ӧ": "ö", "ѵ": "v", "ү": "y", "ӑ": "ă", "ӗ": "ĕ", "ӱ": "ÿ",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ь": "B",
    "Ӕ": "Æ", "Ө": "Ø", "Ё": "Ë", "Ї": "Ï", "Ӓ": "Ä", "Ӧ": "Ö", "Ѵ": "V", "Ү": "Y", "З": "3",
    # Greek
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ζ": "z", "η": "nh", "ι": "i", "κ": "k", "μ": "um", "ν": "vn", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "uy", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú", "ϊ": "ï", "ϋ": "ü",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϊ": "Ï", "Ϋ": "Ÿ",
    # Armenian, Cherokee, Coptic and Lisu capitals
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C",
    # unusual Latin letters
    "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ɴ": "n", "ʀ": "r", "ʜ": "h", "ʟ": "l", "ʙ": "b", "ɢ": "g",
    "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "ɵ": "ø", "Ɵ": "Ø", "ǀ": "l", "ꞵ": "ß", "ƽ": "s",
}

#: Lower-case letters above that resemble only the capital they come from.
ONLY_LOWERED = frozenset("вкмнтгпьβγεζηκμστωχ")

#: Spacing characters besides U+0020 that no category marks as such.
OTHER_SPACES = "\t\n\v\f\r\x85  "
#: Invisible characters that are not of category Cf.
OTHER_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"

EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}]")
WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}͏]*\p{L}[\p{L}\p{M}\p{Cf}͏]*")
#: JVM pattern: a text without such a character is plain as it is.  A look-alike is odd wherever it stands.
ODD_TEXT = r"[^\x20-\x7e¡-¬®-ıĴ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏḀ-ỿ‐-‧‰-⁞€]"
ODD_TEXT += "|[" + "".join(x for x in LOOKS_LIKE if not regex.match(ODD_TEXT, x)) + "]"  # those within the ranges above; a longer list costs time

#: Costs of the automaton: a look-alike or ignorable character; another letter, a letter of the word that the token lacks, a letter of the token that the word lacks.
FREE, OTHER_LETTER, MISSING_LETTER, EXTRA_LETTER = 0.0, 1.0, 1.0, 1.0


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """Script of a letter, by the first word of its Unicode name; empty for other characters."""
    if not ch.isalpha():
        return ""
    name = ud.name(ch, "")
    return "LATIN" if name.startswith(("MODIFIER LETTER", "FEMININE", "MASCULINE")) else name.split(" ")[0]


@lru_cache(maxsize=100_000)
def expanded(ch: str) -> str:
    """A character in ordinary width: wide, narrow, styled and ligature forms written out."""
    if ch in LOOKS_LIKE:
        return ch
    parts = ud.decomposition(ch).split(" ")
    tag = parts[0] if parts[0].startswith("<") else ""
    if tag in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or (tag == "<compat>" and ud.category(ch) in ("Lu", "Ll", "Lt", "Nl")):
        return ud.normalize("NFKC", ch)
    return ch


def is_space(ch: str) -> bool:
    return ch in OTHER_SPACES or (ud.category(ch) == "Zs" and ch != " ")


def is_invisible(ch: str) -> bool:
    return ud.category(ch) in ("Cf", "Cc") and ch not in OTHER_SPACES or ch in OTHER_INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def emoji_needs(text: str, i: int) -> bool:
    """Whether the invisible character at ``i`` belongs to an emoji."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if text[i] == "‍":
        return bool((EMOJI.match(before) or before == "️") and EMOJI.match(after))
    if text[i] in "︎️":
        return bool(EMOJI.match(before)) or (before in "0123456789#*" and after == "⃣" and before != "")
    if "\U000e0020" <= text[i] <= "\U000e007f":
        return bool(regex.search("\U0001f3f4[\U000e0020-\U000e007f]*$", text[:i]))
    return False


def bare(text: str) -> str:
    """Without invisible characters, of ordinary width, composed, with ordinary spaces."""
    out = []
    for i, ch in enumerate(text):
        if is_space(ch):
            out.append(" ")
        elif not is_invisible(ch) or emoji_needs(text, i):
            out.append(expanded(ch))
    return ud.normalize("NFC", "".join(out))


def options(ch: str) -> str:
    """Plain letters a letter may stand for, itself first."""
    return ch + LOOKS_LIKE.get(ch, "")


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """Letter -> smallest letter that it is tied to by look-alikes, in either direction."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for ch, looks in LOOKS_LIKE.items():
        for x in looks:
            a, b = sorted((find(ch.lower()), find(x.lower())))
            parent[b] = a
    return {x: find(x) for x in list(parent)}


def skeleton(word: str) -> str:
    """The same for any two words the automaton can match free of cost."""
    c = _classes()
    return "".join(c.get(x, x) for x in bare(word).lower())


def is_odd(word: str) -> bool:
    """Whether a word may be a disguised one: it isn't plain, or has letters of two scripts, or might be read as Latin."""
    clean = bare(word)
    if clean != word:
        return True
    scripts = {script(x) for x in clean if x.isalpha()}
    if scripts == {"LATIN"}:
        return any(x in LOOKS_LIKE for x in clean)
    return len(scripts) > 1 or all(x in LOOKS_LIKE for x in clean)


class Trie:
    """Plain words with their counts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = max(node.get("", 0), count)

    def best(self, token: str, budget: float = FREE) -> tuple[float, int, str] | None:
        """The word of least cost, then the most frequent, then the first: (cost, -count, word); None if all cost more than ``budget``.

        A state is a place in the trie, which its spelling names, with the least
        cost it was reached at.  Ignorable characters leave states as they are,
        look-alikes follow an edge free of cost; another letter, a missing and an
        extra one have their price.
        """
        states = self._with_missing({"": (FREE, self.root)}, budget)
        for raw in ud.normalize("NFC", token):
            if is_invisible(raw):
                continue
            for ch in expanded(raw).lower():
                follow: dict[str, tuple[float, dict]] = {}
                free = options(ch)
                for spelt, (cost, node) in states.items():
                    for nxt in free:
                        if nxt in node:
                            self._reach(follow, spelt + nxt, cost + FREE, node[nxt])
                    if cost + OTHER_LETTER <= budget:
                        for nxt, child in node.items():
                            if nxt and nxt not in free:
                                self._reach(follow, spelt + nxt, cost + OTHER_LETTER, child)
                    if cost + EXTRA_LETTER <= budget:
                        self._reach(follow, spelt, cost + EXTRA_LETTER, node)
                states = self._with_missing(follow, budget)
                if not states:
                    return None
        return min(((cost, -node[""], spelt) for spelt, (cost, node) in states.items() if "" in node), default=None)

    @staticmethod
    def _reach(states: dict[str, tuple[float, dict]], spelt: str, cost: float, node: dict) -> None:
        if spelt not in states or cost < states[spelt][0]:
            states[spelt] = (cost, node)

    @staticmethod
    def _with_missing(states: dict[str, tuple[float, dict]], budget: float) -> dict[str, tuple[float, dict]]:
        """States, and those that follow where the token lacks letters of the word."""
        open_ = [(cost, spelt, node) for spelt, (cost, node) in states.items() if cost + MISSING_LETTER <= budget]
        while open_:
            cost, spelt, node = open_.pop()
            price = cost + MISSING_LETTER
            for nxt, child in node.items():
                if nxt and (spelt + nxt not in states or price < states[spelt + nxt][0]):
                    states[spelt + nxt] = (price, child)
                    if price + MISSING_LETTER <= budget:
                        open_.append((price, spelt + nxt, child))
        return states

    def read(self, token: str, budget: float = FREE) -> str | None:
        """The canonical spelling of a token, if a word is near enough."""
        found = self.best(token, budget)
        return found[2] if found else None


def by_table(word: str) -> str:
    """Plain form of a word no vocabulary word looks like."""
    clean = bare(word)
    letters = [x for x in clean if x.isalpha()]
    scripts = {script(x) for x in letters}
    if scripts == {"LATIN"} or len(scripts) < 2:
        return "".join(LOOKS_LIKE[x][0] if script(x) == "LATIN" and x in LOOKS_LIKE else x for x in clean)
    foreign = [x for x in letters if script(x) != "LATIN" and (x not in LOOKS_LIKE or x in ONLY_LOWERED)]
    latin = [x for x in letters if script(x) == "LATIN"]
    if not foreign or 2 * len(latin) >= len(letters):
        return ud.normalize("NFC", "".join(LOOKS_LIKE[x][0] if x in LOOKS_LIKE else x for x in clean))
    own = max({script(x) for x in foreign}, key=[script(x) for x in foreign].count)
    back = {looks[0]: x for x, looks in reversed(LOOKS_LIKE.items()) if script(x) == own}
    return "".join(back.get(x, x) if script(x) != own else x for x in clean)


def in_case_of(word: str, token: str) -> str:
    """A lower-case word in the letter case of the token it stands for."""
    shape = bare(token)
    if len(shape) != len(word):
        return word.upper() if shape.isupper() else word.capitalize() if shape[:1].isupper() else word
    return "".join(w.upper() if s.isupper() and len(w.upper()) == 1 else w for w, s in zip(word, shape, strict=True))


def plain_text(text: str, canonical: dict[str, str | None]) -> str:
    """Plain form of a text; ``canonical`` has the spellings found for its odd words."""
    tokens = list(WORD.finditer(text))
    native = set()  # scripts that the text is written in: a whole word of theirs that reads as no plain word
    for m in tokens:
        scripts = {script(x) for x in m.group() if x.isalpha()}
        if len(scripts) == 1 and "LATIN" not in scripts and len(m.group()) > 2 and not canonical.get(m.group()):
            native |= scripts
    out, at = [], 0
    for m in tokens:
        out.append(text[at : m.start()])
        at, token = m.end(), m.group()
        if not is_odd(token):
            out.append(token)
            continue
        scripts = {script(x) for x in bare(token) if x.isalpha()}
        found = canonical.get(token)
        if len(scripts) == 1 and "LATIN" not in scripts and (found is None or scripts <= native):
            out.append(bare(token))  # a word of a text that is written in this script
        else:
            out.append(in_case_of(found, token) if found else by_table(token))
    out.append(text[at:])
    return bare("".join(out))
