"""Regular expressions and label sets (Java regex syntax, as used by Spark).

# --- fixed values: these must stay exactly as written for results to match ---
TITLES   Inaugural|State of the Union            speeches picked for analysis
NOISE    ^(?:\\(.*\\)$|\\.)                        stage directions such as "(Applause.)" and lines that start with "."
BOILER   Transcript|\\n                            boilerplate word and newlines inside a transcript
POST     http\\S+|#\\S+|@\\S+                        links, hashtags and mentions in a post
FOOTNOTE \\[(.*)\\]                                bracketed footnote marks, greedy
CLASS LABELS  negative, neutral, positive
DEFAULT INFO  No info available
OPEN END      Incumbent -> 2021
FALLBACK LANGUAGE  no features in text
# --- end of fixed values ---

The sentence and word patterns below are our own rules (no trained tokenizer is involved).
"""

# --- fixed values (see module docstring) ---
RX_TITLES = r"Inaugural|State of the Union"
RX_NOISE = r"^(?:\(.*\)$|\.)"
RX_BOILER = r"Transcript|\n"
RX_POST = r"(?U)http\S+|#\S+|@\S+"
RX_FOOTNOTE = r"\[(.*)\]"
CLASS_LABELS = ["negative", "neutral", "positive"]
DEFAULT_INFO = "No info available"
OPEN_END_TEXT = "Incumbent"
OPEN_END_YEAR = 2021
NO_LANGUAGE = "no features in text"
# --- end of fixed values ---

# Whitespace trimming with Unicode-aware \s (Python's str.strip / rstrip semantics).
RX_STRIP = r"(?U)^\s+|\s+$"
RX_RSTRIP = r"(?U)\s+$"

# Sentence end: run of . ! ? with optional closing quotes/brackets, followed by whitespace.
RX_SENT = r"""([.!?]+["')\]]*)\s+"""
# Character used to mark sentence boundaries before splitting (never occurs in prose).
SENT_MARK = "\u001f"

# Word tokens: maximal runs of letters (RX_WORD separates them).
RX_WORD = r"[^\p{L}]+"
RX_LETTERS = r"\p{L}+"
