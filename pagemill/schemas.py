"""Fixed schemas of the tables the engine reads and writes."""

SITES = ("site string, url string, adapter string, formats array<string>, include_re string, exclude_re string, "
         "max_pages int, max_depth int")
RESOURCES = "url string, status int, html string, fetched_at double"
TOC = "array<struct<level:int,title:string,anchor:string>>"
CHUNKS = ("site string, url string, path string, title string, seq int, heading_path array<string>, "
          "tokens int, text string")
MANIFEST = ("name string, url string, adapter string, out_dir string, pages bigint, failed bigint, "
            "started_at double, finished_at double, source string")
