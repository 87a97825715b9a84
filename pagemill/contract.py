"""Spellings and limits that other tools observe."""

from __future__ import annotations

import re

# Reserved spellings.
TOKEN = re.compile(r"⟦WT:\d{6}⟧")
TOKEN_FORMAT = "⟦WT:{:06d}⟧"
#: The same for Spark's regular expressions.
TOKEN_SQL = r"⟦WT:[0-9]{6}⟧"
MARKER = "data-wt-segment"
LOCATION = "<!--wt-location:"

# Elements by their part in a page.
BLOCK = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "th", "td", "caption", "figcaption", "label", "summary")
STANDALONE = ("a", "button", "legend", "option")
FLOW = ("address", "article", "aside", "body", "div", "footer", "header", "main", "nav", "section")
EXCLUDED = ("script", "style", "noscript", "pre", "code", "svg", "math")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ATTRIBUTES = ("alt", "aria-label", "aria-description", "title", "placeholder")
SEMANTIC = {
    "p": "paragraph", "li": "list_item", "dt": "term", "dd": "definition", "th": "table_header", "td": "table_cell",
    "caption": "caption", "figcaption": "figure_caption", "label": "label", "summary": "summary", "a": "link",
    "button": "button", "legend": "legend", "option": "option",
}

# Limits.
MAX_HTML_BYTES = 10 << 20
MAX_ASSET_BYTES = 25 << 20
MAX_CSS_DEPTH = 5
MAX_DATA_STYLESHEET = 256 << 10
MAX_REQUESTS = 256
MAX_REDIRECTS, MAX_TOTAL_REDIRECTS = 5, 32
MAX_TOTAL_BYTES = 128 << 20
MAX_ZONE_CHARS, MAX_TARGET_ZONES = 12_000, 64
MAX_SUMMARY = 4000
MAX_RETRIES = 2
MAX_DETECT_CHARS = 100_000
DIMENSIONS = ("semantic_fidelity", "qualification_preservation", "naturalness", "terminology", "boundary_consistency", "protected_content")


class ContractError(ValueError):
    """A table breaks the contract of a stage; each stage has a class of its own."""


class SegmentError(ContractError):
    pass


class CaptureError(ContractError):
    pass


class BudgetError(CaptureError):
    """A resource budget ran out; never downgraded to a warning."""


class ExtractionError(ContractError):
    pass


class ProtectionError(ContractError):
    pass


class ZoneError(ContractError):
    pass


class TranslationError(ContractError):
    pass


class TerminologyError(ContractError):
    pass


class AssemblyError(ContractError):
    pass


class QAFailure(ContractError):
    pass
