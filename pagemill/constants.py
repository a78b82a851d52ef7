"""Marker namespace, patterns, codes and thresholds of the document model."""

NAMESPACE = "srcmap"

#: Patterns in Java syntax. U: Unicode classes; d: only \n ends a line.
NUMBERED_HEADING = r"(?Ud)^\d+(?:\.\d+)*\s+\S"
BULLET_ITEM = r"(?Ud)^[*+\-•▪◦]\s+(.+)$"
ORDERED_ITEM = r"(?Ud)^\d+[.)]\s+(.+)$"
POSSIBLE_HYPHENATION = r"(?Ud)\w-\s+(?=\w)"
CITATION = r"(?Ud)\[(\d+(?:\s*,\s*\d+)*)\]"
BIBLIOGRAPHY_ENTRY = r"(?Ud)^\[(\d+)\]\s+.+"
FOOTNOTE = r"(?Ud)\[\^(\d+)\]"
FOOTNOTE_DEFINITION = r"(?Ud)^\[\^(\d+)\]:\s+.+"
FIGURE = r"(?Udiu)\b(?:Figure|Fig\.)\s+(\d+)\b"
TABLE = r"(?Udiu)\bTable\s+(\d+)\b"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?"
SUM_FRACTION = rf"(?Ud)^({IDENTIFIER}\({IDENTIFIER}\))\s*=\s*sum_([A-Za-z0-9]+)\s+({IDENTIFIER}(?:\s*\*\s*{IDENTIFIER})*)\s*/\s*({IDENTIFIER})$"
FORMULA_CANDIDATE = r"(?Ud)^[A-Za-z][A-Za-z0-9_]*(?:\([A-Za-z0-9_]+\))?\s*=\s*[A-Za-z0-9_()\[\]{}+\-*/^.,\\\s]+$"
MARKDOWN_HEADING = r"(?Udm)^#{1,6}\s"
GFM_TABLE = r"(?Udm)^\|[^\n]*\|\r?\n\|(?:\s*:?-{3,}:?\s*\|)+\s*$"
DISPLAY_FORMULA = r"(?dm)^\$\$"
UNREADABLE_GLYPH = r"\(cid:"
FORMULA_DELIMITER = r"(?<!\\)\$\$(?!\$)"
TABLE_SEPARATOR = r"(?Ud)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"
WORD = r"(?U)[^\W_]+"
IMAGE = r"!\[[^\]\n]*\]\((?:<([^>\n]+)>|([^)\n]+))\)"
HTML_IMAGE = r"""(?is)<img\b[^>]*\bsrc\s*=\s*['"]([^'"]+)['"][^>]*>"""
ANY_FORMULA = r"(?s)\$\$|(?<!\\)\$(?!\$).+?(?<!\\)\$(?!\$)"
ASSET_MARKER = r"<!-- srcmap:asset=(\S+) page=[1-9][0-9]* -->"
VECTOR_CAPTION = r"(?Udiu)^(?:Figure|Fig\.)\s*\d+\s*:"
RASTER_CAPTION = r"(?Udiu)^(?:Figure|Fig\.|Abbildung)\s+\d+\b.+"
FORBIDDEN_OUTPUT = r"(?i)file://|<\s*/?\s*(?:html|head|body|script|iframe|meta)\b|<!doctype|<\?"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"

LINKS_TITLE = "**Native PDF links**"
LINKS_TITLE_PATTERN = r"\*\*Native PDF links\*\*"

NAMED_HEADINGS = ("abstract", "references", "acknowledgements")

#: Warning codes that keep a document from being indexed as it is.
BLOCKERS = ("DISPLAY_FORMULA_LAYOUT_NOT_RECONSTRUCTED", "FORMULA_NOT_RECONSTRUCTED", "MULTILINE_TABLE_CELLS", "MULTI_COLUMN_LAYOUT", "OCR_LAYOUT_FALLBACK", "OCR_LOW_CONFIDENCE", "UNREADABLE_PDF_GLYPHS", "UNSUPPORTED_TABLE_STRUCTURE")
#: Warning codes that send a page to a vision model.
VISION_RISKS = ("FORMULA_NOT_RECONSTRUCTED", "MULTILINE_TABLE_CELLS", "MULTI_COLUMN_LAYOUT", "POSSIBLE_HYPHENATION_PRESERVED", "UNREADABLE_PDF_GLYPHS", "UNSUPPORTED_EMBEDDED_IMAGE", "UNSUPPORTED_TABLE_STRUCTURE")
#: Warning codes that readers of a derivative see.
READER_CODES = ("FORMULA_NOT_RECONSTRUCTED", "OCR_LOW_CONFIDENCE", "UNREADABLE_PDF_GLYPHS", "VISION_BACKEND_UNREACHABLE", "VISION_INVALID_JSON", "VISION_LOW_CONFIDENCE", "VISION_TIMEOUT", "VISION_UNVERIFIABLE_CONTENT")

MAX_BATCH_PAGES, MAX_DENSE_PAGES = 6, 1
MIN_IMAGE_AREA = 50_000
