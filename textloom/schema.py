"""Table schemas, as DDL."""

CHUNKS = "collection string, chunk_id string, source string, filename string, heading string, parent_heading string, category string, section_ordinal int, sub_index int, word_count int, text string, embedding array<float>"
MANIFEST = "collection string, root string, path string, md5 string"
PAGES = "url string, content string, depth int"
QUERIES = "query_id bigint, query string, n_results int, category string, filename string, collection string"
EVENTS = "ts timestamp, path string, kind string"
