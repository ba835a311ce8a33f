"""Schemas of the tables that operators exchange. An element becomes a node; both are rows in reading order."""

ELEMENTS = (
    "doc_id string, seq int, element_id string, parent_id string, category string, text string, text_as_html string, page_number int, "
    "page_name string, filename string, file_directory string, languages array<string>, link_texts array<string>, link_urls array<string>, "
    "emphasized_text_contents array<string>, category_depth int, is_continuation boolean, detection_class_prob double, "
    "coordinates struct<points: array<struct<x: double, y: double>>>, image_path string, image_base64 string, image_mime_type string, "
    "image_width int, section string, sent_from array<string>, sent_to array<string>, subject string, orig_elements array<struct<text: string, category: string>>, extra map<string, string>"
)

#: The kinds of elements.
TITLE, LIST_ITEM, NARRATIVE, FORMULA, PLAIN = "Title", "ListItem", "NarrativeText", "Formula", "UncategorizedText"
TEXT_COMPOSITE, COMPOSITE, CAPTION, IMAGE, TABLE, HEADER, FOOTER = "Composite-TextOnly", "Composite", "FigureCaption", "Image", "Table", "Header", "Footer"
TEXT_KINDS = (NARRATIVE, LIST_ITEM, FORMULA, PLAIN, TEXT_COMPOSITE)
IMAGE_KINDS = (CAPTION, IMAGE)

#: Columns of nodes that merge as sorted sets when nodes are combined; of all others the first value stays.
SET_COLUMNS = ("page_numbers", "page_names", "languages", "emphasized_text_contents", "link_texts", "link_urls")
