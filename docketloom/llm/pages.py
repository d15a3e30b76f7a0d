"""Lines of printed pages: furniture, margin marks, headings, title blocks.

Everything here looks at a line and a few lines around it, so it works inside
a range of a long text that is read with a halo. Page furniture is printed
within the width of a page, so a line of more than ``PAGE_WIDTH`` characters is none.
"""

from __future__ import annotations

import re

PAGE_WIDTH = 110
MARK = re.compile(r"^[A-Z] {2,}(?=\S)")

_furniture = [
    re.compile(p)
    for p in (
        r"^.*\f",  # a form feed opens a page
        r"^\s*[-–—]\s*\w{1,4}\s*[-–—]\s*$",  # - 12 -
        r"^\s*\[\w{1,4}\]\s*$",  # [12]
        r"^\s*[Cc]\S{3,4}\W{0,3}\.{2,}\s*\S{1,4}\s*$",  # Contd... 12
        r"^\s*[Pp]\S{2,3}\s+\S{1,4}\s+\S{2}\s+\S{1,4}\s*$",  # Page 2 of 9
        r"^\s*[Pp]\S{3}\s+\d{1,4}\s*$",  # Page 2
        r"^.{5,60}?\s{3,}P\S{3}\s+\S{1,4}\s+\S{2}\s+\S{1,4}\s*$",  # title    Page 2 of 9
        r"^\s*\S{1,4}\s*\|\s*\S( \S){3}\s*$",  # 2 | P a g e
        r"^\S+ {2,}\S{1,4}/\S{1,4}\s*$",  # file    2/9
        r"^\s*\S{4}\]\s{2,}\S.{4,60}?\s{2,}\S{1,5}\s*$",  # 1983]    THE REPORTS    254
        r"^\s*\S{1,5}\s{2,}\S.{4,60}?\s{2,}\[\S{4}\s*$",  # 254    THE REPORTS    [1983
        r"^\s*\d\w{0,3}\s{4,}\S.{2,50}\s[vy]\.?(?:\s.{0,40})?$",  # 254      A v. B
        r"^\S.{2,50}\s[vy]\.?(?:\s.{0,40})?\s{4,}\w{0,3}\d\s*$",  # A v. B      254
    )
]
_digit = re.compile(r"[0-9\f|]|[-–—\[]\s*\w{1,4}\s*[-–—\]]")
_bare_page = re.compile(r"^\s*[Pp]\S{2,3}\s+\S{1,4}\s+\S{2}\s+\S{1,4}\s*$")
_spaced_page = re.compile(r"^\s*\S{1,4}\s*\|\s*\S( \S){3}\s*$")
_title_after = re.compile(r"^.{3,70}?\s{2,}\(\S{4}\)\s*$")
_figure = re.compile(r"^\s*[\d,.]{1,14}\s*$")
_folio = re.compile(r"^\s*\d{1,4}\s*$")


def _mostly_upper(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 6 and sum(c.isupper() for c in letters) >= 0.85 * len(letters)


def is_figure(line: str) -> bool:
    """A line of a column of figures."""
    return bool(_figure.match(line))


def furniture(lines: list[str]) -> list[bool]:
    """For every line whether it is page furniture: running title, folio or page mark."""
    n = len(lines)
    out = [False] * n
    for i, line in enumerate(lines):
        if not line or len(line) > PAGE_WIDTH or not _digit.search(line):
            continue
        if any(p.match(line) for p in _furniture):
            out[i] = True
            continue
        if _folio.match(line) and i > 0:
            before = lines[i - 1] if i else ""
            after = lines[i + 1] if i + 1 < n else ""
            # one figure by itself is a folio; columns of figures have several rows
            if not is_figure(before) and not is_figure(after):
                out[i] = True
    for i in range(n):
        if not out[i]:
            continue
        if i and not out[i - 1] and _bare_page.match(lines[i]) and _mostly_upper(lines[i - 1]):
            out[i - 1] = True
        if i + 1 < n and not out[i + 1] and _spaced_page.match(lines[i]) and _title_after.match(lines[i + 1]):
            out[i + 1] = True
    return out


_versus = re.compile(r"^\s*(?:[vy]|[vy][s5]|ver[s5]u[s5])\.?\s*$", re.IGNORECASE)


def title_lines(lines: list[str]) -> int:
    """Number of lines of the title block at the top of a text, 0 where there is none.

    A block names the parties around a line ``v.`` and ends at the first blank
    line, or where the first long line begins. Before that line it has neither
    long lines nor lines of eight words that go on in lower case, as running text has; it may be of any length.
    """
    for at, line in enumerate(lines):
        if _versus.match(line):
            break
        bare = line.lstrip()
        if bare[:1].islower() and bare.count(" ") >= 7 or len(line) > 90 and not bare.startswith("("):
            return 0
    else:
        return 0
    for i in range(at + 1, len(lines)):
        if not lines[i].strip() or len(lines[i]) > 90 and not lines[i].lstrip().startswith("("):
            return i
    return len(lines)
