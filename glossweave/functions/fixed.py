"""Fixed values.

The word lists, labels, cut-offs, patterns and characters below decide results and
are therefore stated literally.  Nothing in this module computes anything.
"""

# Every character that Unicode text stripping removes, in code point order.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a regular expression class (Java and RE2).
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Line boundaries of a plain-text reference file.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Lead-ins a model may put before its reply.
LEAD_INS = (
    "Translation:",
    "Here is the translation:",
    "The translation is:",
    "Translated text:",
    "Result:",
    "Output:",
    "Answer:",
    "Response:",
)

# A reply line holding one of these (in lower case) is runner metadata.
METADATA_KEYWORDS = ("used_tools=", "tools_errors=", "delegations=", "i18n=")

# Reply lines starting with one of these are dropped.
DROPPED_LINE_STARTS = ("[Translation of item", "#")

# Instruction per quality tier; an unknown tier is read as the default one.
QUALITY_NOTES = {
    "high": (
        "Preserve all academic and technical terminology precisely. "
        "Maintain a formal register and ensure cultural nuance is respected."
    ),
    "medium": "Ensure accurate meaning transfer with natural, readable phrasing.",
    "low": (
        "Provide a quick translation focusing on core meaning over stylistic precision."
    ),
}
DEFAULT_QUALITY = "high"

# Score bands, highest cut-off first.
BLEU_BANDS = (
    (40, "High quality — approaches human translation"),
    (20, "Understandable — core meaning conveyed"),
    (0, "Low quality — significant errors likely"),
)
CHRF_BANDS = (
    (60, "High quality"),
    (40, "Acceptable"),
    (0, "Needs improvement"),
)

# Share of dropped segments above which a length mismatch is an error.
MISMATCH_ERROR_SHARE = 0.20

# N-gram orders and the chrF recall weight.
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2

# The published "13a" tokenizer (regular expression, replacement), in order.
# The published first class also holds the space; padding a space changes no token.
TOKENIZER_13A = (
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
