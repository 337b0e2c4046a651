"""Options of the conversions, and the constants of layout analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SheetOptions:
    sheet_names: bool = True
    hidden: bool = True
    formulas: bool = True
    compact: bool = False
    separator: str = "\n\n"
    skip_empty_rows: bool = True
    mark_hidden: bool = True


@dataclass(frozen=True)
class WordOptions:
    preserve_formatting: bool = True
    images: bool = True
    headers_footers: bool = False
    compact: bool = False
    #: Keep well-defined oddities of older converters: list numbers modulo ten, tables run together.
    compat: bool = False


@dataclass(frozen=True)
class PdfOptions:
    strip_headers_footers: bool = True
    strip_blank_pages: bool = True
    strip_page_numbers: bool = False
    detect_lists: bool = True
    detect_headings: bool = True
    preserve_formatting: bool = True
    images: bool = True
    scan_mode: bool = True
    compact: bool = False
    page_separator: str = "\n"
    #: 'compat' measures gaps bottom-up, 'topdown' as the items lie.
    gap_mode: str = "compat"


@dataclass(frozen=True)
class Options:
    recursive: bool = False
    extensions: tuple[str, ...] = (".pdf", ".docx", ".xlsx")
    skip_existing: bool = True
    output_directory: str = ""
    #: Larger files are reported, not read: a row holds its whole file, and can't hold more.
    most_bytes: int = (1 << 31) - (1 << 16)
    pdf: PdfOptions = field(default_factory=PdfOptions)
    docx: WordOptions = field(default_factory=WordOptions)
    xlsx: SheetOptions = field(default_factory=SheetOptions)


@dataclass(frozen=True)
class Layout:
    """Tolerances of page layout, in points."""

    y_tolerance: float = 5
    footer_share: float = 0.88
    footer_y: float = 700
    column_spacing: float = 40
    alignment: float = 20
    bucket: float = 15
    ref_gap: float = 30
    min_column_items: int = 3
    header_octets: int = 30
    region: float = 10
    alnum_factor: float = 3
    punctuation_gap: float = 30
    other_gap: float = 10
    row_tolerance: float = 35
    multi_line_tolerance: float = 20
    refs: int = 3
    ref_share: float = 0.8
    wrap: float = 10
    same_line: float = 2
    #: A header row that holds one of these makes a table of three items or more.
    known_headers: tuple[str, ...] = ("Version Date Description", "Element Evaluator Actions", "Requirement Dependency")


LAYOUT = Layout()
HEADING_RATIO, HEADING_EXTRA = 1.5, 4
INDENT, MAX_LEVEL = 20, 6
