"""Log-text measures as native column expressions.

Every measure works on the whole text of one build in one row, so none of them
shuffles.  Line counts use a pattern that swallows the rest of the line after
its first hit: the number of matches is then the number of matching lines, in
one linear scan and without splitting the text into an array.

Pattern flags: ``i`` ignore case, ``d`` only ``\\n`` ends a line for ``.`` and
``$``, ``U`` Unicode meaning of ``\\b \\d \\w \\s`` and of case.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import rules


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


# ------------------------------------------------------------------ lines

def lines(text: Column) -> Column:
    """Lines of a text; an empty or missing text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(text, "\n", -1)
    )


def has_many_lines(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))


def log_text(raw_logs: Column, step_lines: Column) -> Column:
    """The text to analyse: the raw log, or the step lines when it has at most one line."""
    return F.when(has_many_lines(raw_logs), raw_logs).otherwise(
        F.coalesce(F.array_join(step_lines, "\n"), F.lit(""))
    )


def log_lines(raw_logs: Column, step_lines: Column) -> Column:
    return F.when(has_many_lines(raw_logs), F.split(raw_logs, "\n", -1)).otherwise(
        F.coalesce(step_lines, F.array().cast("array<string>"))
    )


def step_lines_text(step_lines: Column) -> Column:
    """Join step lines so that one entry stays one line, whatever it contains."""
    return F.array_join(F.transform(step_lines, lambda x: F.replace(x, F.lit("\n"), F.lit("\r"))), "\n")


def nonblank_line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{rules.WHITESPACE_CLASS}][^\\n]*"))


def line_chars(text: Column) -> Column:
    """Characters without the line breaks."""
    return F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def char_density(text: Column, digits: int = 2) -> Column:
    return round_to(line_chars(text) / F.greatest(nonblank_line_count(text), F.lit(1)), digits)


def raw_line_count(text: Column, empty_lines: int = 0) -> Column:
    """All lines; an empty text counts ``empty_lines`` (0 for raw logs, 1 for job traces)."""
    n = F.char_length(text) - line_chars(text) + 1
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty_lines)).otherwise(n)


def raw_char_density(text: Column, digits: int = 2) -> Column:
    return round_to(F.char_length(text) / F.greatest(raw_line_count(text), F.lit(1)), digits)


# --------------------------------------------------------------- keywords

def keyword_line_count(lowered: Column, words: list[str]) -> Column:
    """Lines of an already lower-cased text that contain any of the words.

    The look-ahead on the first letters skips most positions at once.
    """
    first = "".join(sorted({w[0] for w in words}))
    return F.regexp_count(lowered, F.lit(f"(?=[{first}])(?:{_any_of(words)})[^\\n]*"))


def keyword_token_count(text: Column, words: list[str]) -> Column:
    return F.regexp_count(text, F.lit(f"(?i)\\b(?:{_any_of(words)})\\b"))


# --------------------------------------------------------------- patterns

# Letters that a case-insensitive pattern also finds as characters whose lower case is
# another one: dotless and dotted i (U+0131, U+0130) and long s (U+017F).
_VARYING = "is"
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def _end(pattern: str, at: int) -> int:
    """Index after the group, set or bound that opens at ``at``."""
    opening, depth, i = pattern[at], 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[" and i > at:
            i = _end(pattern, i) - 1
        elif pattern[i] == opening and opening != "[":
            depth += 1
        elif pattern[i] == _CLOSING[opening] and i > at:
            depth -= 1
            if depth <= 0:
                return i + 1
        i += 1
    return len(pattern)


def needles(pattern: str) -> list[str]:
    """Lower-case texts of which every match contains one; empty if the pattern has no such text.

    Each top-level alternative gives the longest run of characters it always holds.  A
    plain substring search is far cheaper than a case-insensitive pattern, and most logs
    contain none of these.
    """
    if pattern.startswith("(?:") and _end(pattern, 0) == len(pattern):
        return needles(pattern[3:-1])
    alternatives: list[list[str]] = [[""]]
    i = 0
    while i < len(pattern):
        runs, c, after = alternatives[-1], pattern[i], i + 1
        literal = ""
        if c == "\\":
            after += 1
            literal = "" if pattern[i + 1].isalnum() else pattern[i + 1]
        elif c in _CLOSING:
            after = _end(pattern, i)
            if c == "{":
                runs[-1] = runs[-1][:-1]
        elif c in "*?":
            runs[-1] = runs[-1][:-1]
        elif c == "|":
            alternatives.append([])
            runs = alternatives[-1]
        elif c not in "+.^$":
            literal = c
        if literal and literal.lower() not in _VARYING:
            runs[-1] += literal.lower()
        else:
            runs.append("")
        i = after
    out = [max(runs, key=len) for runs in alternatives]
    return out if all(len(n) > 1 for n in out) else []


def pattern_count(text: Column, lowered: Column, pattern: str, flags: str = "idU") -> Column:
    """Matches of one pattern over the whole text, skipped where no match is possible."""
    count = F.regexp_count(text, F.lit(f"(?{flags}){pattern}"))
    found = needles(pattern)
    if not found:
        return count
    possible = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in found])
    return F.when(possible, count).otherwise(F.lit(0))


def pattern_total(text: Column, lowered: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [pattern_count(text, lowered, p) for p in patterns])


def line_pattern_total(line_array: Column, patterns: list[str]) -> Column:
    """Sum over lines and patterns of "this line matches this pattern"."""
    def hits(pattern: str) -> Column:
        return F.size(F.filter(line_array, lambda x: F.rlike(x, F.lit(f"(?idU){pattern}"))))

    return reduce(lambda a, b: a + b, [hits(p) for p in patterns])


def base64_count(text: Column, lowered: Column) -> Column:
    return pattern_count(text, lowered, rules.BASE64_PATTERN)


def base64_strict_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + rules.BASE64_STRICT_PATTERN))


def base64_line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{rules.BASE64_LINE_PATTERN}[^\\n]*"))


# -------------------------------------------------------------- addresses

_PRIVATE_IP = (
    r"^0*(?:10|127)\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\."
)


def ip_addresses(text: Column, pattern: str = rules.IP_PATTERN) -> Column:
    """Distinct dotted quads of a text."""
    found = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
    return F.array_distinct(F.when(F.contains(text, F.lit(".")), found).otherwise(
        F.array().cast("array<string>")))


def external_ip_count(text: Column) -> Column:
    return F.size(F.filter(ip_addresses(text), lambda ip: ~F.rlike(ip, F.lit(_PRIVATE_IP))))


def external_ip_count_strict(text: Column) -> Column:
    """Without private and version-like prefixes, octets 0-255."""
    prefixes = "|".join(re.escape(p) for p in rules.NON_PUBLIC_PREFIXES_STRICT)
    return F.size(F.filter(ip_addresses(text), lambda ip: ~F.rlike(ip, F.lit(f"^(?:{prefixes})"))
                           & F.forall(F.split(ip, "\\."), lambda o: o.cast("int") <= 255)))


def external_ip_count_octets(text: Column) -> Column:
    prefixes = "|".join(re.escape(p) for p in rules.NON_PUBLIC_PREFIXES_GENERATED)
    return F.size(F.filter(ip_addresses(text, rules.IP_OCTET_PATTERN),
                           lambda ip: ~F.rlike(ip, F.lit(f"^(?:{prefixes})"))))


def trusted_by_length(trusted: list[str]) -> dict[int, list[str]]:
    """Suffixes grouped by length, without those already covered by a shorter one."""
    unique = set(trusted)
    shortest = [s for s in unique if not any(s != o and s.endswith(o) for o in unique)]
    out: dict[int, list[str]] = {}
    for s in sorted(shortest, key=lambda x: (len(x), x)):
        out.setdefault(len(s), []).append(s)
    return out


def is_trusted(domain: Column, trusted: list[str] = rules.TRUSTED_DOMAINS,
               strict_dot: bool = False) -> Column:
    """Domain ends with a trusted suffix: one hash lookup per suffix length.

    ``strict_dot`` also asks for a dot (or the start) before the suffix, so that
    ``evilgithub.com`` is not taken for ``github.com``.
    """
    subject = F.concat(F.lit("."), domain) if strict_dot else domain
    names = ["." + t for t in trusted] if strict_dot else trusted
    tests = [F.right(subject, F.lit(n)).isin(group) for n, group in trusted_by_length(names).items()]
    return reduce(lambda a, b: a | b, tests)


def urls(text: Column) -> Column:
    """What follows the scheme of every URL, in order."""
    found = F.regexp_extract_all(text, F.lit("(?iU)" + rules.URL_PATTERN), F.lit(1))
    return F.when(F.contains(F.lower(text), F.lit("://")), found).otherwise(
        F.array().cast("array<string>"))


def url_domain(url: Column) -> Column:
    return F.substring_index(F.lower(F.substring_index(url, "/", 1)), ":", 1)


def untrusted_domains(text: Column, trusted: list[str] = rules.TRUSTED_DOMAINS,
                      strict_dot: bool = False) -> Column:
    """Domains of the untrusted URLs, one entry per occurrence."""
    return F.filter(F.transform(urls(text), url_domain),
                    lambda d: ~is_trusted(d, trusted, strict_dot))


def external_url_count(text: Column, trusted: list[str] = rules.TRUSTED_DOMAINS,
                       strict_dot: bool = False) -> Column:
    return F.size(untrusted_domains(text, trusted, strict_dot))


def untrusted_hosts(text: Column, trusted: list[str]) -> Column:
    """Hosts by the host-only pattern (scheme in lower case), one entry per occurrence."""
    found = F.regexp_extract_all(text, F.lit(rules.HOST_PATTERN), F.lit(1))
    return F.filter(found, lambda h: ~is_trusted(F.lower(h), trusted))


# -------------------------------------------------------------- templates

def mask_variables(text: Column) -> Column:
    """Replace variable parts, rule after rule; line-wise exact on multi-line texts."""
    return reduce(lambda t, rule: F.regexp_replace(t, "(?U)" + rule[0], rule[1]),
                  rules.MASK_PATTERNS, text)


def mask_line(line: Column) -> Column:
    """:func:`mask_variables` of one line; a line that no rule can match is not read by all rules.

    Every rule needs a digit, a slash or, for hashes, a run of hexadecimal letters.
    """
    return F.when(F.rlike(line, F.lit(rules.MASKED_CHARACTERS)), mask_variables(line)).otherwise(line)


def tokenize(line: Column) -> Column:
    return F.array_remove(F.split(line, "(?U)" + rules.TOKEN_DELIMITERS, -1), "")


def simple_template(text: Column, hash_length: int = 32) -> Column:
    """Numbers and long hex runs replaced; works on a line or on a whole text."""
    numbered = F.regexp_replace(text, r"\p{Nd}+", "<NUM>")
    return F.regexp_replace(numbered, rf"(?i)[a-f0-9]{{{hash_length},}}", "<HASH>")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(rules.WHITESPACE))


def simple_templates(text: Column) -> Column:
    """Sorted templates of the non-blank lines of a text, one entry per line."""
    parts = F.transform(F.split(simple_template(text), "\n", -1), strip)
    return F.sort_array(F.array_remove(parts, ""))


def run_ends(sorted_array: Column) -> Column:
    """1-based last positions of the runs of equal values in a sorted array."""
    n = F.size(sorted_array)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), n),
                 lambda i: (i == n) | (F.get(sorted_array, i - 1) != F.get(sorted_array, i))))


def entropy_of_runs(ends: Column, digits: int = 4) -> Column:
    """Shannon entropy (bits) of the value counts that the run ends describe."""
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    n = F.element_at(ends, -1)
    counts = F.zip_with(ends, starts, lambda e, s: (e - s).cast("double"))
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(F.size(ends) <= 1, F.lit(0.0)).otherwise(round_to(F.log2(n) - weighted / n, digits))


def template_id(tokens: Column) -> Column:
    return F.substring(F.md5(F.array_join(tokens, " ")), 1, 12)
