"""Schemas of the engine's tables, as DDL."""

PAGES = "proc_id string, page_no int, text string, source string"
PAGE_ROWS = "proc_id string, page_no int, table_no int, row_no int, cells array<string>"
OCR_TEXTS = "proc_id string, page_no int, image_no int, text string, width int, height int"
EXPENSE_CODES = "category int, grp int, modality int, element int, sub int, name string, row_no int"
ELEMENTS = "element int, name string"
ANALYSES = "analysis_id string, created timestamp, month string, proc_id string, nup string, type string, result string, supplier string, tax_id string, unit_code string, unit_name string, instrument string, total decimal(18,2), caveats array<string>, ok array<string>, detail map<string,string>"
EXPECTED = "proc_id string, nup string, min_items int, has_credit_note boolean, has_sicaf boolean, unit_code string"
