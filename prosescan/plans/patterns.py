"""Watched phrases and templates compiled to Java regular expressions, when the plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from prosescan.functions.text import LEFT, RIGHT
from prosescan.plans import lexicon

# Limits of a template's open slots and least length of its literal part.
LATIN_SLOT_WORDS, CJK_SLOT_CHARS, SOFT_SLOT_CHARS = 5, 15, 40
LEAST_LATIN, LEAST_CJK = 5, 2
#: A template that begins so describes a pattern instead of giving one.
DESCRIBING = re.compile(r"^(?:the|a|an)\s+(?:[a-z-]+\s+)?(?:form|pattern|construction|version|variant|structure)\b", re.IGNORECASE)
SLOT = re.compile(r"\[(?P<slot>[^\]]*)\]|(?P<dots>……?|\.\.\.)|(?<![A-Za-z])(?P<hole>[XYZN])(?![A-Za-z])")
QUOTES = "\"“”「」"


@dataclass(frozen=True)
class Pattern:
    """One watched phrase: its rule, the Java pattern and how sure a match is."""

    rule_id: str
    phrase: str
    kind: str
    pattern: str
    confidence: float
    #: The plain spellings, where the phrase is literal.
    spellings: tuple[str, ...] = field(default=())
    #: Lower-case strings of which a text must hold one to match.
    needles: tuple[str, ...] = field(default=())


def cjk_share(text: str) -> float:
    """Share of code points from U+3000 on among those that aren't white space."""
    ink = [c for c in text if not c.isspace()]
    return sum(c >= "　" for c in ink) / len(ink) if ink else 0.0


def quoted(text: str) -> str:
    """Text as a literal part of a Java pattern."""
    return re.sub(r"([^\w\s]|_)", lambda m: rf"\x{{{ord(m[1]):X}}}" if ord(m[1]) > 126 else "\\" + m[1] if m[1] != "_" else "_", text)


def spellings(text: str) -> list[str]:
    """The alternatives of a phrase given as ``a / b``, without quotes around them."""
    return [x for x in (part.strip().strip(QUOTES).strip() for part in re.split(r"\s+/\s+", text)) if x]


def too_common(text: str) -> bool:
    """Whether a phrase is no evidence: blank, a stop word, or fewer than three Chinese characters."""
    bare = text.strip().strip(QUOTES).strip()
    return not bare or cjk_share(bare) >= 0.5 and len(bare) < 3 or bare in lexicon.TOO_COMMON_CJK.split() or bare.lower() in lexicon.TOO_COMMON.split()


def literal(rule_id: str, text: str, note: str | None = None) -> Pattern | None:
    """Pattern of a literal phrase: at word borders where all its spellings begin or end with a word character."""
    if too_common(text):
        return None
    ways = spellings(text)
    cjk = cjk_share(text) >= 0.5
    body = "|".join(map(quoted, ways))
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    if cjk:
        pattern = f"(?:{body})"
    else:
        pattern = f"(?iu){LEFT if all(word(w[0]) for w in ways) else ''}(?:{body}){RIGHT if all(word(w[-1]) for w in ways) else ''}"
    confidence = 0.8 - 0.05 * (len(ways) > 1) - 0.25 * bool(note) + 0.1 * (len(text.split()) >= 3)
    return Pattern(rule_id, text, "literal", pattern, max(0.2, min(0.95, round(confidence, 2))), tuple(ways), tuple(w.lower() for w in ways))


def template_source(template: str) -> str | None:
    """Pattern of one template, None if it has too little to hold on to."""
    template = template.strip()
    if not template or DESCRIBING.match(template):
        return None
    cjk = cjk_share(template) >= 0.3
    if cjk:
        strict, soft = rf"[^\n]{{1,{CJK_SLOT_CHARS}}}?", rf"(?=[^\n]{{1,{CJK_SLOT_CHARS}}}?[\w\x{{4E00}}-\x{{9FFF}}])[^\n]{{1,{SOFT_SLOT_CHARS}}}?"
    else:
        strict, soft = rf"[^\s.;!?]+(?:\s+[^\s.;!?]+){{0,{LATIN_SLOT_WORDS - 1}}}", rf"(?=[^\n]{{1,{SOFT_SLOT_CHARS}}}?[A-Za-z0-9])[^\n]{{1,{SOFT_SLOT_CHARS}}}?"
    slots = list(SLOT.finditer(template))
    gap = r"\s*" if slots else ""
    parts, held, at = [], 0, 0
    for m in [*slots, None]:
        text = template[at : m.start() if m else len(template)]
        text = text.strip() if slots else text
        if text:
            held += len(text)
            parts.append(quoted(text) + gap)
        if m is None:
            break
        at = m.end()
        choices = [c.strip() for c in (m["slot"] or "").split(",") if c.strip()]
        if m["slot"] is not None and "," in m["slot"]:
            if choices:
                held += sum(map(len, choices))
                parts.append("(?:" + "|".join(r"\s+".join(map(quoted, c.split())) for c in choices) + ")" + gap)
        else:
            parts.append((strict if m["hole"] else soft) + gap)
    if not parts or held < (LEAST_CJK if cjk else LEAST_LATIN):
        return None
    return f"{'' if cjk else LEFT}(?:{''.join(parts)})"


def template(rule_id: str, text: str, note: str | None = None) -> Pattern | None:
    """Pattern of a template, or of several parted by quotes and a slash; None if it cannot be compiled."""
    bare = text.strip(QUOTES).strip()
    variants = [v.strip(QUOTES + " ") for v in re.split(rf"[{QUOTES}]\s*/\s*[{QUOTES}]", bare)]
    sources = [(v, s) for v, s in ((v, template_source(v)) for v in variants) if s]
    # the longest literal part of each variant must be there; a variant without one lets every text pass
    parts = [max((x.strip().lower() for x in SLOT.split(v) if x and not SLOT.fullmatch(x) and x.strip() not in {"X", "Y", "Z", "N"}), key=len, default="") for v, _ in sources]
    needles = tuple(parts) if all(parts) and not any("[" in v for v, _ in sources) else ()
    return Pattern(rule_id, text, "template", f"(?iu)(?:{'|'.join(s for _, s in sources)})", 0.5 if note else 0.7, needles=needles) if sources else None


def compiled(language: str | None = None) -> tuple[list[Pattern], list[dict]]:
    """Patterns of the watched phrases of rules that apply to a language, and the phrases that have none."""
    langs = {r["rule_id"]: r["languages"] for r in lexicon.rules()}
    done, skipped = [], []
    for p in lexicon.phrases():
        if language and language not in langs.get(p["rule_id"], []):
            continue
        built = (template if p["kind"] == "template" else literal)(p["rule_id"], p["text"], p["note"])
        if built:
            done.append(built)
        else:
            skipped.append(p)
    return done, skipped


def marker(text: str) -> str:
    """Pattern of a behaviour marker; one that starts with ^ must open a clause."""
    opens, text = text.startswith("^"), text.removeprefix("^")
    if cjk_share(text) >= 0.3:
        body = quoted(text)
    else:
        body = LEFT + quoted(text.strip()) + (RIGHT if text[-1:].isalnum() else "")
    return rf"(?:^|[.!?。！？,，;；:：—\n]\s*){body}" if opens else body
