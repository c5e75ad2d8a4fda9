"""The rows that the queries of `inline` have to give, as their rules say."""

from __future__ import annotations

# fmt: off
EXPECTED: dict[str, list[tuple]] = {
    "budget_rollup": [
        (0, '# Map'),
        (1, ''),
        (2, '_61 files. Rolled up by directory to stay inside the session budget — read `MAP.md` for any one of them in full._'),
        (3, ''),
        (4, '- **(root)/** (1) — `top.py`'),
        (5, '- **pkg0/** (20) — `file000.py`, `file003.py`, `file006.py`, `file009.py`, `file012.py`, `file015.py`, `file018.py`, `file021.py` _+12 more_'),
        (6, '- **pkg1/** (20) — `file001.py`, `file004.py`, `file007.py`, `file010.py`, `file013.py`, `file016.py`, `file019.py`, `file022.py` _+12 more_'),
        (7, '- **pkg2/** (20) — `file002.py`, `file005.py`, `file008.py`, `file011.py`, `file014.py`, `file017.py`, `file020.py`, `file023.py` _+12 more_'),
        (8, '----'),
        (9, 'line 0 of a text without rows'),
        (10, 'line 1 of a text without rows'),
        (11, ''),
        (12, '_Cut to fit the session budget. Read `MAP.md` for anything missing here._'),
    ],
    "carried_records": [
        ('r', '2024-02-03-new.md', '_Last session (2024-02-03) — New work_\n\n**Remaining**\n- finish it well'),
        ('t', 'notes.md', '_Last session (notes) — notes_\n\n**Blockers**\n- a line that takes some room, number 000\n- a line that takes some room, number 001\n- a line that takes some room, number 002\n- a line that takes some room, number 003\n- a line that takes some room, number 004\n- a line that takes some room, number 005\n- a line that takes some room, number 006\n- a line that takes some room, number 007\n- a line that takes some room, number 008\n- a line that takes some room, number 009\n- a line that takes some room, number 010\n- a line that takes some room, number 011\n- a line that takes some room, number 012\n- a line that takes some room, number 013\n- a line that takes some room, number 014\n- a line that takes some room, number 015\n- a line that takes some room, number 016\n- a line that takes some room, number 017\n- a line that takes some room, number 018\n- a line that takes some room, number 019\n- a line that takes some room, number 020\n- a line that takes some room, number 021\n- a line that takes some room, number 022\n- a line that takes some room, number 023\n- a line that takes some room, number 024\n- a line that takes some room, number 025\n- a line that takes some room, number 026\n- a line that takes some room, number 027\n\n_…truncated — read `notes.md` for the rest._'),
    ],
    "command_log": [
        ('2024-01-01T10:00:00', 'docker compose'),
        ('2024-01-02T10:00:00', 'pytest'),
    ],
    "doc_tags": [
        (0, 'Adds things'),
        (1, 'Loads it'),
        (2, 'Opens a bay'),
        (3, 'See Bay.Open for it'),
        (4, 'Loads bays'),
        (5, 'Uses Bay and x'),
        (6, 'Adds x'),
        (7, 'a List<String> of name@host.org by @Test'),
        (8, 'Title and blanks here'),
        (9, 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx…'),
        (10, ''),
    ],
    "document_store": [
        ('a.md', 'First'),
        ('b.md', 'bad � byte'),
    ],
    "import_extract": [
        ('c/A.java', 0, 'a.b.C.d'),
        ('c/A.java', 1, 'a.E'),
        ('c/a.c', 0, 'bay.h'),
        ('c/a.cs', 0, 'A.B'),
        ('c/a.cs', 1, 'C'),
        ('c/a.dart', 0, 'package:a/b.dart'),
        ('c/a.ex', 0, 'A.B'),
        ('c/a.ex', 1, 'C'),
        ('c/a.go', 0, 'fmt'),
        ('c/a.go', 1, 'a/b-c'),
        ('c/a.js', 0, './lib/cart'),
        ('c/a.js', 1, 'fs'),
        ('c/a.kt', 0, 'a.b'),
        ('c/a.lua', 0, 'a.b'),
        ('c/a.php', 0, 'App\\Cart'),
        ('c/a.php', 1, 'x.php'),
        ('c/a.py', 0, 'src.store'),
        ('c/a.py', 1, 'os'),
        ('c/a.py', 2, 're'),
        ('c/a.rb', 0, 'json'),
        ('c/a.rb', 1, 'cart'),
        ('c/a.rs', 0, 'crate::bay::Bay'),
        ('c/a.rs', 1, 'std::io'),
        ('c/a.scala', 0, 'a.b.C'),
        ('c/a.swift', 0, 'UIKit'),
    ],
    "index_document": [
        (0, '# Architecture map — demo'),
        (1, ''),
        (2, '## Quick Index'),
        (3, ''),
        (4, '- **`api/routes.py`** (11L, 2fn) — Routes.'),
        (5, '- **`models/user.py`** (3L, 1cls) — —'),
        (6, '- **`proto/fleet.proto`** (5L, 2fn/1cls) — —'),
        (7, '- **`src/billing.py`** (18L, 1fn/1cls) — Bills for orders'),
        (8, '- **`src/empty.py`** (1L) — —'),
        (9, '- **`src/store.py`** (7L, 1fn) — Keeps orders'),
        (10, '- **`tests/test_billing.py`** (7L, 1fn) — —'),
        (11, '- **`web/app.js`** (10L, 1fn) — Serves the shop'),
        (12, '- **`web/lib/cart.js`** (4L, 1fn) — The cart'),
        (13, ''),
        (14, '## Data model'),
        (15, ''),
        (16, '- **`daily`**  _(migrations/001.sql)_'),
        (17, '- **`orders`** — Orders as placed (partitioned, 2 partitions)  _(migrations/001.sql)_'),
        (18, '- **`User`**  _(models/user.py)_'),
        (19, ''),
        (20, '## API surface'),
        (21, ''),
        (22, '- `ANY    /carts`  _(openapi/shop.yaml)_'),
        (23, '- `ANY    /carts/{id}`  _(openapi/shop.yaml)_'),
        (24, '- `GET    /health`  _(web/app.js)_'),
        (25, '- `GET    /ping`  _(api/routes.py)_'),
        (26, '- `POST   /ping`  _(api/routes.py)_'),
        (27, '- `GET    /v1/orders/{id}`  _(api/routes.py)_'),
        (28, '- `gRPC   Fleet/Locate`  _(proto/fleet.proto)_'),
        (29, '- `gRPC   Fleet/Stop`  _(proto/fleet.proto)_'),
        (30, ''),
        (31, '## Configuration'),
        (32, ''),
        (33, '- `API_TOKEN`'),
        (34, '- `DATABASE_URL`'),
        (35, '- `EXTRA_NAME`'),
        (36, '- `SHOP_KEY`'),
        (37, '> `.env` is not in .gitignore: such a file mostly holds live credentials, which a commit would publish.'),
        (38, ''),
        (39, '## Deployment'),
        (40, ''),
        (41, '- **Deployment** (1) — `shop`'),
        (42, '- **Secret** (1) — `db-login`  _(names only)_'),
        (43, '- **Service** (1) — `shop`'),
        (44, '- **ansible** (1) — `roles/web/tasks/main.yml`'),
        (45, '- **ci** (2) — `.github/workflows/ci.yml`, `Dockerfile`'),
        (46, '- **images** (1) — `registry.local/shop:1.2`'),
        (47, ''),
        (48, '## Stored material (not source)'),
        (49, ''),
        (50, '- **`scans/`** — 13 files, 91B — .png ×13'),
        (51, ''),
        (52, '## Impact'),
        (53, ''),
        (54, '- **`src/billing.py`** — used by `src/store.py`; **tested by** `tests/test_billing.py`'),
        (55, '- **`web/lib/cart.js`** — used by `web/app.js`'),
        (56, ''),
        (57, '## Full Detail'),
        (58, ''),
        (59, '### daily'),
        (60, 'defined in `migrations/001.sql`'),
        (61, '### orders'),
        (62, 'Orders as placed (partitioned, 2 partitions)'),
        (63, 'columns: id, total'),
        (64, 'defined in `migrations/001.sql`'),
        (65, '### User'),
        (66, 'defined in `models/user.py`'),
        (67, '## `api/routes.py`'),
        (68, 'Routes.'),
        (69, '- `one(id)`'),
        (70, '- `ping()`'),
        (71, '## `models/user.py`'),
        (72, '- **class User**'),
        (73, '## `proto/fleet.proto`'),
        (74, '- **class Fleet**'),
        (75, '- `Locate(Req)`'),
        (76, '- `Stop(Req)`'),
        (77, '## `src/billing.py`'),
        (78, 'Bills for orders'),
        (79, '**Constants:** MAX_LINES'),
        (80, '- **class Bill** — One bill.'),
        (81, '  - methods: total'),
        (82, '- `charge(order, amount)` — Charge an order at postgres://admin:<REDACTED>@db.internal/main'),
        (83, '## `src/empty.py`'),
        (84, '## `src/store.py`'),
        (85, 'Keeps orders'),
        (86, '- `load(key)`'),
        (87, '## `tests/test_billing.py`'),
        (88, '- `test_total()`'),
        (89, '## `web/app.js`'),
        (90, 'Serves the shop'),
        (91, '**Constants:** LIMIT_ROWS'),
        (92, '- `start(port)`'),
        (93, '## `web/lib/cart.js`'),
        (94, 'The cart'),
        (95, '- `add(item, n)`'),
    ],
    "leading_comments": [
        ('b/1.js', 'Draws charts', False, 0),
        ('b/2.rb', 'Sends mail', False, 0),
        ('b/3.swift', 'Starts it', False, 0),
        ('b/4.c', 'CRC', False, 0),
        ('b/5.ex', 'Keeps time.', True, 0),
        ('b/6.rs', 'Reads things from disk', True, 0),
        ('b/7.go', '', True, 0),
        ('b/8.py', '', False, 0),
        ('b/9.py', 'only a comment', False, 0),
        ('b/a.py', '', True, 1),
        ('b/b.ts', 'Adds Item to carts', True, 0),
        ('b/c.cs', 'Loads bays', True, 0),
        ('b/d.sh', 'Rotates logs', False, 0),
    ],
    "magic_kinds": [
        ('b.tsv', None, 'c68fc640'),
        ('k.pdf', 'PDF document', None),
        ('l.png', 'PNG image', '866f145e'),
        ('m.jpg', 'JPEG image', 'cb5187fa'),
        ('n.gif', 'GIF image', '685d83de'),
        ('o.parquet', 'Parquet', '422ed1c3'),
        ('p.log', None, '12ba0be6'),
        ('t.bin', 'ELF binary', '6d465a9d'),
        ('u.dat', None, '00000000'),
    ],
    "memory_counts": [
        ('r', 6, 5, 4),
        ('s', 0, 0, 1),
    ],
    "memory_rules": [
        ('r', 1363, 'word word word word\n\n**Rule 2**\n\n_…more rules — 4 in total._'),
        ('s', 18, '**Be kind**\nWhy\nso'),
    ],
    "memory_titles": [
        ('r', 'decisions', 'Decide 1', 'd-1.md', 2),
        ('r', 'decisions', 'Decide 2', 'd-2.md', 3),
        ('r', 'decisions', 'Decide 3', 'd-3.md', 4),
        ('r', 'decisions', 'Decide 4', 'd-4.md', 5),
        ('r', 'decisions', 'Decide 5', 'd-5.md', 6),
        ('r', 'decisions', 'd 0', 'd-0.md', 1),
        ('r', 'lessons', 'Learn 0 password = <REDACTED>', 'l0.md', 7),
        ('r', 'lessons', 'Learn 1 password = <REDACTED>', 'l1.md', 8),
    ],
    "milestones": [
        ('2024-02-01', 'Second', '', 2, 1),
        ('2024-03-01', 'Third', 'some\ntext', 1, 1),
    ],
    "peek_find": [
        ('a.csv', 0, '3 columns, 900 data rows'),
        ('a.csv', 1, 'columns: `id`, `city`, `amount`'),
        ('a.csv', 2, "rows matching 'TOWN77' (8 shown):"),
        ('a.csv', 3, '  line 79: 77 | town77 | 154'),
        ('a.csv', 4, '  line 772: 770 | town770 | 1540'),
        ('a.csv', 5, '  line 773: 771 | town771 | 1542'),
        ('a.csv', 6, '  line 774: 772 | town772 | 1544'),
        ('a.csv', 7, '  line 775: 773 | town773 | 1546'),
        ('a.csv', 8, '  line 776: 774 | town774 | 1548'),
        ('a.csv', 9, '  line 777: 775 | town775 | 1550'),
        ('a.csv', 10, '  line 778: 776 | town776 | 1552'),
        ('d.json', 0, 'structure (keys and types only, no values):'),
        ('d.json', 1, '  {a: {b: [2 × int]}, c: str, e: [1 × [1 × [1 × [1 × …]]]]}'),
        ('d.json', 2, "1 occurrence(s) of 'hid':"),
        ('d.json', 3, '  …{"a": {"b": [1, 2]}, "c": "hidden", "e": [[[[[1]]]]]}…'),
        ('f.xlsx', 0, '2 member(s), 404B uncompressed'),
        ('f.xlsx', 1, 'spreadsheet sheets: `Duty`'),
        ('f.xlsx', 2, '3 columns on `Duty`'),
        ('f.xlsx', 3, 'columns: `hs_code`, `description`'),
        ('f.xlsx', 4, "rows matching 'cattle' (1 of 1 shown):"),
        ('f.xlsx', 5, '  0102 | cattle | '),
        ('f.xlsx', 6, "members matching 'cattle':"),
        ('g.docx', 0, '2 member(s), 95B uncompressed'),
        ('g.docx', 1, '2 paragraph(s) of text'),
        ('g.docx', 2, "paragraphs matching 'second' (1 of 1 shown):"),
        ('g.docx', 3, '  ¶2: Second'),
        ('g.docx', 4, 'title: Plan'),
        ('g.docx', 5, "members matching 'second':"),
        ('h.zip', 0, '30 member(s), 30B uncompressed'),
        ('h.zip', 1, "members matching 'm2':"),
        ('h.zip', 2, '  m20'),
        ('h.zip', 3, '  m21'),
        ('h.zip', 4, '  m22'),
        ('h.zip', 5, '  m23'),
        ('h.zip', 6, '  m24'),
        ('h.zip', 7, '  m25'),
        ('h.zip', 8, '  m26'),
        ('h.zip', 9, '  m27'),
        ('h.zip', 10, '  m28'),
        ('h.zip', 11, '  m29'),
        ('i.tar.gz', 0, '27 member(s), 351B uncompressed'),
        ('i.tar.gz', 1, "members matching 'SIDE1':"),
        ('i.tar.gz', 2, '  inside10.txt  10B'),
        ('i.tar.gz', 3, '  inside11.txt  11B'),
        ('i.tar.gz', 4, '  inside12.txt  12B'),
        ('i.tar.gz', 5, '  inside13.txt  13B'),
        ('i.tar.gz', 6, '  inside14.txt  14B'),
        ('i.tar.gz', 7, '  inside15.txt  15B'),
        ('i.tar.gz', 8, '  inside16.txt  16B'),
        ('i.tar.gz', 9, '  inside17.txt  17B'),
        ('i.tar.gz', 10, '  inside18.txt  18B'),
        ('i.tar.gz', 11, '  inside19.txt  19B'),
        ('j.db', 0, '2 table(s)'),
        ('j.db', 1, '  `bays` (40 rows) — id, code'),
        ('j.db', 2, '  `lanes` (0 rows) — name'),
        ('j.db', 3, "tables or columns matching 'COD': bays"),
        ('k.pdf', 0, '1 page(s)'),
        ('k.pdf', 1, 'Title: Report'),
        ('k.pdf', 2, 'Author: Me'),
        ('k.pdf', 3, "1 match(es) for 'there':"),
        ('k.pdf', 4, '  …Hello there again…'),
        ('p.log', 0, '2 lines'),
        ('p.log', 1, "lines matching 'TW' (1 shown):"),
        ('p.log', 2, '  2: two'),
    ],
    "peek_formats": [
        ('a.csv', 0, '3 columns, 900 data rows'),
        ('a.csv', 1, 'columns: `id`, `city`, `amount`'),
        ('a.csv', 2, 'first rows:'),
        ('a.csv', 3, '  0 | town0 | 0'),
        ('a.csv', 4, '  1 | town1 | 2'),
        ('a.csv', 5, '  2 | town2 | 4'),
        ('b.tsv', 0, '2 columns, 2 data rows'),
        ('b.tsv', 1, 'columns: `a`, `b`'),
        ('b.tsv', 2, 'ragged: 2 different row widths seen — {2: 1, 1: 1}'),
        ('b.tsv', 3, 'first rows:'),
        ('b.tsv', 4, '  1 | 2'),
        ('b.tsv', 5, '  3'),
        ('c.csv', 0, 'unrecognised; 75% printable in the first 4KB'),
        ('c.csv', 1, 'crc32 of first 4KB: b4779c7b'),
        ('c.csv', 2, 'readable strings: binary'),
        ('d.json', 0, 'structure (keys and types only, no values):'),
        ('d.json', 1, '  {a: {b: [2 × int]}, c: str, e: [1 × [1 × [1 × [1 × …]]]]}'),
        ('e.json', 0, 'not valid JSON as a whole (JSONDecodeError); may be JSON Lines'),
        ('e.json', 1, '2 lines'),
        ('e.json', 2, 'first lines:'),
        ('e.json', 3, '  1: {"a": 1}'),
        ('e.json', 4, '  2: {"a": 2}'),
        ('f.xlsx', 0, '2 member(s), 404B uncompressed'),
        ('f.xlsx', 1, 'spreadsheet sheets: `Duty`'),
        ('f.xlsx', 2, '3 columns on `Duty`'),
        ('f.xlsx', 3, 'columns: `hs_code`, `description`'),
        ('f.xlsx', 4, 'first rows:'),
        ('f.xlsx', 5, '  0101 | horses & mules | '),
        ('f.xlsx', 6, '  0102 | cattle | '),
        ('f.xlsx', 7, 'members:'),
        ('f.xlsx', 8, '  xl/workbook.xml'),
        ('f.xlsx', 9, '  xl/worksheets/sheet1.xml'),
        ('g.docx', 0, '2 member(s), 95B uncompressed'),
        ('g.docx', 1, '2 paragraph(s) of text'),
        ('g.docx', 2, 'opening text:'),
        ('g.docx', 3, '  First one'),
        ('g.docx', 4, '  Second'),
        ('g.docx', 5, 'title: Plan'),
        ('g.docx', 6, 'members:'),
        ('g.docx', 7, '  word/document.xml'),
        ('g.docx', 8, '  docProps/core.xml'),
        ('h.zip', 0, '30 member(s), 30B uncompressed'),
        ('h.zip', 1, 'members:'),
        ('h.zip', 2, '  m00'),
        ('h.zip', 3, '  m01'),
        ('h.zip', 4, '  m02'),
        ('h.zip', 5, '  m03'),
        ('h.zip', 6, '  m04'),
        ('h.zip', 7, '  m05'),
        ('h.zip', 8, '  m06'),
        ('h.zip', 9, '  m07'),
        ('h.zip', 10, '  m08'),
        ('h.zip', 11, '  m09'),
        ('h.zip', 12, '  m10'),
        ('h.zip', 13, '  m11'),
        ('h.zip', 14, '  m12'),
        ('h.zip', 15, '  m13'),
        ('h.zip', 16, '  m14'),
        ('h.zip', 17, '  m15'),
        ('h.zip', 18, '  m16'),
        ('h.zip', 19, '  m17'),
        ('h.zip', 20, '  m18'),
        ('h.zip', 21, '  m19'),
        ('h.zip', 22, '  m20'),
        ('h.zip', 23, '  m21'),
        ('h.zip', 24, '  m22'),
        ('h.zip', 25, '  m23'),
        ('h.zip', 26, '  m24'),
        ('h.zip', 27, '  …+5 more'),
        ('i.tar.gz', 0, '27 member(s), 351B uncompressed'),
        ('i.tar.gz', 1, 'members:'),
        ('i.tar.gz', 2, '  inside00.txt  0B'),
        ('i.tar.gz', 3, '  inside01.txt  1B'),
        ('i.tar.gz', 4, '  inside02.txt  2B'),
        ('i.tar.gz', 5, '  inside03.txt  3B'),
        ('i.tar.gz', 6, '  inside04.txt  4B'),
        ('i.tar.gz', 7, '  inside05.txt  5B'),
        ('i.tar.gz', 8, '  inside06.txt  6B'),
        ('i.tar.gz', 9, '  inside07.txt  7B'),
        ('i.tar.gz', 10, '  inside08.txt  8B'),
        ('i.tar.gz', 11, '  inside09.txt  9B'),
        ('i.tar.gz', 12, '  inside10.txt  10B'),
        ('i.tar.gz', 13, '  inside11.txt  11B'),
        ('i.tar.gz', 14, '  inside12.txt  12B'),
        ('i.tar.gz', 15, '  inside13.txt  13B'),
        ('i.tar.gz', 16, '  inside14.txt  14B'),
        ('i.tar.gz', 17, '  inside15.txt  15B'),
        ('i.tar.gz', 18, '  inside16.txt  16B'),
        ('i.tar.gz', 19, '  inside17.txt  17B'),
        ('i.tar.gz', 20, '  inside18.txt  18B'),
        ('i.tar.gz', 21, '  inside19.txt  19B'),
        ('i.tar.gz', 22, '  inside20.txt  20B'),
        ('i.tar.gz', 23, '  inside21.txt  21B'),
        ('i.tar.gz', 24, '  inside22.txt  22B'),
        ('i.tar.gz', 25, '  inside23.txt  23B'),
        ('i.tar.gz', 26, '  inside24.txt  24B'),
        ('i.tar.gz', 27, '  …+2 more'),
        ('id_rsa', 0, 'Refused: files of this kind hold credentials, and no summary of them is safe.'),
        ('j.db', 0, '2 table(s)'),
        ('j.db', 1, '  `bays` (40 rows) — id, code'),
        ('j.db', 2, '  `lanes` (0 rows) — name'),
        ('k.pdf', 0, '1 page(s)'),
        ('k.pdf', 1, 'Title: Report'),
        ('k.pdf', 2, 'Author: Me'),
        ('k.pdf', 3, 'extracted text (first 400 chars):'),
        ('k.pdf', 4, '  Hello there again'),
        ('l.png', 0, 'PNG 640×480, 8-bit RGB'),
        ('m.jpg', 0, 'JPEG 30×20'),
        ('n.gif', 0, 'GIF 3×4'),
        ('o.parquet', 0, 'columnar (Parquet) — identified and measured only.'),
        ('o.parquet', 1, 'Parquet; 100% printable in the first 4KB'),
        ('o.parquet', 2, 'crc32 of first 4KB: 422ed1c3'),
        ('o.parquet', 3, 'readable strings: PAR1xxxx'),
        ('p.log', 0, '2 lines'),
        ('p.log', 1, 'first lines:'),
        ('p.log', 2, '  1: one'),
        ('p.log', 3, '  2: two'),
        ('q.py', 0, '1 lines'),
        ('q.py', 1, 'first lines:'),
        ('q.py', 2, '  1: x = 1'),
        ('r.xlsx', 0, '1 lines'),
        ('r.xlsx', 1, 'first lines:'),
        ('r.xlsx', 2, '  1: not a zip'),
        ('s.txt', 0, '2 lines'),
        ('s.txt', 1, 'first lines:'),
        ('s.txt', 2, '  1: token = <REDACTED>'),
        ('s.txt', 3, '  2: plain'),
        ('t.bin', 0, 'opaque binary — identified and measured only.'),
        ('t.bin', 1, 'ELF binary; 49% printable in the first 4KB'),
        ('t.bin', 2, 'crc32 of first 4KB: 6d465a9d'),
        ('t.bin', 3, 'readable strings:  !"#$%&\'()*+,-./0123456789:;<=>?@ABCDEFG'),
        ('u.dat', 0, 'opaque binary — identified and measured only.'),
        ('u.dat', 1, 'unrecognised; 0% printable in the first 4KB'),
        ('u.dat', 2, 'crc32 of first 4KB: 00000000'),
        ('u.dat', 3, 'readable strings: '),
        ('v.bmp', 0, 'image, header not recognised'),
    ],
    "read_notices": [
        (5, 'lock file', '`package-lock.json` is a lock file (~278 tokens): search it for the one fact that is wanted, unless the file itself is being debugged.'),
        (6, 'build directory', '`app.js` is a build directory file (~1,389 tokens): search it for the one fact that is wanted, unless the file itself is being debugged.'),
        (7, 'generated', '`app.min.js` is a generated file (~10 tokens): search it for the one fact that is wanted, unless the file itself is being debugged.'),
        (8, 'large', '`large.log` is large (~55,556 tokens), which stay in the session: a search or a range of lines costs a fraction.'),
        (9, 'very large', '`huge.log` is very large (~277,778 tokens), which stay in the session: a search or a range of lines costs a fraction.'),
    ],
    "record_sections": [
        ('2024-01-01-old.md', 0, 'Remaining', '- forgotten'),
        ('2024-02-03-new.md', 0, 'Done', '- all'),
        ('2024-02-03-new.md', 1, 'Remaining', '- finish it'),
        ('2024-02-03-new.md', 2, 'Blockers', '- none'),
        ('2024-02-03-new.md', 3, 'Odd', 'kept'),
        ('2024-02-03-new.md', 4, 'Remaining', '- finish it well'),
    ],
    "repo_caps": [
        ('routes', '1', 'Showing 60 of 62; search the sources for the rest.'),
        ('routes', '10001', '- `GET    /r00`  _(api.js)_'),
        ('routes', '10060', '- `GET    /r59`  _(api.js)_'),
        ('settings', '0', 'Showing 50 of 55.'),
        ('settings', '1NAME_00', '- `NAME_00`'),
        ('settings', '1NAME_49', '- `NAME_49`'),
        ('tables', '0', 'Names only, of 45 tables and models; each is told in the detail.'),
        ('tables', '1t00', '- `t00`'),
        ('tables', '1t44', '- `t44`'),
    ],
    "repo_index": [
        ('deployment', '199998Deployment', '- **Deployment** (1) — `shop`'),
        ('deployment', '199998Secret', '- **Secret** (1) — `db-login`  _(names only)_'),
        ('deployment', '199998Service', '- **Service** (1) — `shop`'),
        ('deployment', '2ansible', '- **ansible** (1) — `roles/web/tasks/main.yml`'),
        ('deployment', '2ci', '- **ci** (2) — `.github/workflows/ci.yml`, `Dockerfile`'),
        ('deployment', '2images', '- **images** (1) — `registry.local/shop:1.2`'),
        ('detail', '1daily', '### daily\ndefined in `migrations/001.sql`'),
        ('detail', '1orders', '### orders\nOrders as placed (partitioned, 2 partitions)\ncolumns: id, total\ndefined in `migrations/001.sql`'),
        ('detail', '1user', '### User\ndefined in `models/user.py`'),
        ('detail', '2api/routes.py', '## `api/routes.py`\nRoutes.\n- `one(id)`\n- `ping()`'),
        ('detail', '2models/user.py', '## `models/user.py`\n- **class User**'),
        ('detail', '2proto/fleet.proto', '## `proto/fleet.proto`\n- **class Fleet**\n- `Locate(Req)`\n- `Stop(Req)`'),
        ('detail', '2src/billing.py', '## `src/billing.py`\nBills for orders\n**Constants:** MAX_LINES\n- **class Bill** — One bill.\n  - methods: total\n- `charge(order, amount)` — Charge an order at postgres://admin:<REDACTED>@db.internal/main'),
        ('detail', '2src/empty.py', '## `src/empty.py`'),
        ('detail', '2src/store.py', '## `src/store.py`\nKeeps orders\n- `load(key)`'),
        ('detail', '2tests/test_billing.py', '## `tests/test_billing.py`\n- `test_total()`'),
        ('detail', '2web/app.js', '## `web/app.js`\nServes the shop\n**Constants:** LIMIT_ROWS\n- `start(port)`'),
        ('detail', '2web/lib/cart.js', '## `web/lib/cart.js`\nThe cart\n- `add(item, n)`'),
        ('impact', '0001', '- **`src/billing.py`** — used by `src/store.py`; **tested by** `tests/test_billing.py`'),
        ('impact', '0002', '- **`web/lib/cart.js`** — used by `web/app.js`'),
        ('index', 'api/routes.py', '- **`api/routes.py`** (11L, 2fn) — Routes.'),
        ('index', 'models/user.py', '- **`models/user.py`** (3L, 1cls) — —'),
        ('index', 'proto/fleet.proto', '- **`proto/fleet.proto`** (5L, 2fn/1cls) — —'),
        ('index', 'src/billing.py', '- **`src/billing.py`** (18L, 1fn/1cls) — Bills for orders'),
        ('index', 'src/empty.py', '- **`src/empty.py`** (1L) — —'),
        ('index', 'src/store.py', '- **`src/store.py`** (7L, 1fn) — Keeps orders'),
        ('index', 'tests/test_billing.py', '- **`tests/test_billing.py`** (7L, 1fn) — —'),
        ('index', 'web/app.js', '- **`web/app.js`** (10L, 1fn) — Serves the shop'),
        ('index', 'web/lib/cart.js', '- **`web/lib/cart.js`** (4L, 1fn) — The cart'),
        ('material', '01', '- **`scans/`** — 13 files, 91B — .png ×13'),
        ('routes', '10001', '- `ANY    /carts`  _(openapi/shop.yaml)_'),
        ('routes', '10002', '- `ANY    /carts/{id}`  _(openapi/shop.yaml)_'),
        ('routes', '10003', '- `GET    /health`  _(web/app.js)_'),
        ('routes', '10004', '- `GET    /ping`  _(api/routes.py)_'),
        ('routes', '10005', '- `POST   /ping`  _(api/routes.py)_'),
        ('routes', '10006', '- `GET    /v1/orders/{id}`  _(api/routes.py)_'),
        ('routes', '20001', '- `gRPC   Fleet/Locate`  _(proto/fleet.proto)_'),
        ('routes', '20002', '- `gRPC   Fleet/Stop`  _(proto/fleet.proto)_'),
        ('settings', '1API_TOKEN', '- `API_TOKEN`'),
        ('settings', '1DATABASE_URL', '- `DATABASE_URL`'),
        ('settings', '1EXTRA_NAME', '- `EXTRA_NAME`'),
        ('settings', '1SHOP_KEY', '- `SHOP_KEY`'),
        ('settings', '2.env', '> `.env` is not in .gitignore: such a file mostly holds live credentials, which a commit would publish.'),
        ('tables', 'daily', '- **`daily`**  _(migrations/001.sql)_'),
        ('tables', 'orders', '- **`orders`** — Orders as placed (partitioned, 2 partitions)  _(migrations/001.sql)_'),
        ('tables', 'user', '- **`User`**  _(models/user.py)_'),
    ],
    "script_bodies": [
        (0, 'Bash', 'the longer body of the two'),
        (1, 'Bash', ''),
        (2, 'Write', 'print(1)'),
        (3, 'Edit', 'print(2)'),
        (4, 'Write', ''),
    ],
    "session_digest": [
        (0, '## Repeated this session'),
        (1, ''),
        (2, '- 4x  `counts calls 0`'),
        (3, ''),
        (4, 'What is worth keeping: `promote FILE NAME --desc TEXT` makes it one command.'),
    ],
    "session_start": [
        (0, ''),
        (1, '### Architecture index'),
        (2, '# Map'),
        (3, ''),
        (4, ''),
        (5, ''),
        (6, '_Cut to fit the session budget. Read `MAP.md` for anything missing here._'),
        (7, ''),
        (8, '### Rules this repository works under'),
        (9, '**Rule**'),
        (10, 'never password = <REDACTED>'),
        (11, ''),
        (12, '### Recorded decisions and lessons'),
        (13, '- **decision** · `d.md` — Use it'),
        (14, ''),
        (15, '### Recent milestones'),
        (16, '- **2024-03-01** — Milestone 3'),
        (17, '- **2024-02-01** — Milestone 2'),
        (18, '- _…and 1 more_'),
        (19, ''),
        (20, '### Where the last session stopped'),
        (21, '_Last session (2024-01-02) — Work_'),
        (22, ''),
        (23, '**Remaining**'),
        (24, '- finish'),
        (25, ''),
        (26, '### Work in flight'),
        (27, 'half way'),
        (28, '3991'),
        (29, ''),
        (30, "### This repository's own tools"),
        (31, '- `tool00` — no description'),
        (32, '- `tool01` — checks'),
        (33, '- `tool02` — no description'),
        (34, '- `tool03` — checks'),
        (35, '- `tool04` — no description'),
        (36, '- `tool05` — checks'),
        (37, '- `tool06` — no description'),
        (38, '- `tool07` — checks'),
        (39, '- `tool08` — no description'),
        (40, '- `tool09` — checks'),
        (41, '- `tool10` — no description'),
        (42, '- `tool11` — checks'),
        (43, '- _…and 2 more_'),
        (44, ''),
        (45, '### Recorded procedures'),
        (46, '- `s.md` — how to deploy'),
        (47, ''),
        (48, '### Reply style'),
        (49, 'Lead with the result. Tables and fragments where they carry the content; say uncertain things once.'),
        (50, ''),
    ],
    "symbols_by_language": [
        ('a/B.scala', 'class', 'Bay', '', ''),
        ('a/B.scala', 'class', 'Yard', '', ''),
        ('a/B.scala', 'func', 'open', '', ''),
        ('a/Bay.cs', 'class', 'Bay', '', ''),
        ('a/Bay.cs', 'func', 'Open', 'int x', ''),
        ('a/Ship.java', 'class', 'Ship', '', ''),
        ('a/Ship.java', 'func', 'load', 'int a', ''),
        ('a/a.dart', 'class', 'A', '', ''),
        ('a/a.dart', 'func', 'run', 'int x', ''),
        ('a/app.swift', 'class', 'App', '', ''),
        ('a/app.swift', 'func', 'run', 'at: Int', ''),
        ('a/bay.c', 'class', 'bay', '', ''),
        ('a/bay.c', 'const', 'MAX_LEN', '', ''),
        ('a/bay.c', 'func', 'open', 'int fd', ''),
        ('a/bay.c', 'func', 'read_all', 'char *p', ''),
        ('a/bay.rs', 'class', 'Bay', '', ''),
        ('a/bay.rs', 'func', 'open', 'x: T', ''),
        ('a/c.ex', 'class', 'Clock.Face', '', ''),
        ('a/c.ex', 'func', 'tick', '', ''),
        ('a/cart.rb', 'class', 'Cart', '', ''),
        ('a/cart.rb', 'func', 'total', '', ''),
        ('a/cart.ts', 'class', 'Cart', '', ''),
        ('a/cart.ts', 'const', 'MAX_ROWS', '', ''),
        ('a/cart.ts', 'func', 'add', 'x', ''),
        ('a/cart.ts', 'func', 'load', 'id, n', ''),
        ('a/cart.ts', 'func', 'total', 'tax: number', ''),
        ('a/f.proto', 'class', 'A', '', ''),
        ('a/f.proto', 'class', 'Fleet', '', ''),
        ('a/f.proto', 'func', 'Run', 'A', ''),
        ('a/m.lua', 'func', 'M.go', 'a', ''),
        ('a/mod.py', 'class', 'Box', '', 'Holds.'),
        ('a/mod.py', 'const', 'LIMIT', '', ''),
        ('a/mod.py', 'func', 'run', 'a', 'Runs it.'),
        ('a/mod.py', 'method', 'Box.put', '', ''),
        ('a/n.nim', 'func', 'open', 'x: int', ''),
        ('a/net.tf', 'class', 'aws_s3.logs', '', ''),
        ('a/net.tf', 'func', 'net', '', ''),
        ('a/pay.go', 'class', 'S', '', ''),
        ('a/pay.go', 'const', 'MaxItems', '', ''),
        ('a/pay.go', 'func', 'Charge', 'a int', ''),
        ('a/pay.php', 'class', 'Pay', '', ''),
        ('a/pay.php', 'func', 'charge', '$a', ''),
        ('a/q.graphql', 'class', 'Filter', '', ''),
        ('a/q.graphql', 'class', 'Order', '', ''),
        ('a/run.sh', 'func', 'go_on', '', ''),
        ('a/run.sh', 'func', 'stop', '', ''),
        ('a/ship.kt', 'class', 'Ship', '', ''),
        ('a/ship.kt', 'const', 'MAX_AGE', '', ''),
        ('a/ship.kt', 'func', 'load', 'x: Int', ''),
        ('a/z.zig', 'const', 'MaxLen', '', ''),
        ('a/z.zig', 'func', 'main', 'a: u8', ''),
    ],
    "text_helpers": [
        ('bar', '#######'),
        ('bytes', '3.0TB'),
        ('bytes: GB at most', '3072.0GB'),
        ('cut: cjk', '400'),
        ('cut: none', '0'),
        ('cut: thai', '476'),
        ('cut: thai, then latin', '692'),
        ('description', 'how to deploy'),
        ('description: no matter', ''),
        ('entities', '&lt; <a> "\''),
        ('estimate: mixed', '4.34'),
        ('flatten', '**Use it**\nWhy\ntext # no'),
        ('headline', 'run( 1 )'),
        ('headline: only comments', '// a'),
        ('model', 'some-model-4'),
        ('nothing: bullets', 'true'),
        ('nothing: empty', 'true'),
        ('nothing: something', 'false'),
        ('slug', 'nder-score-more'),
        ('slug: nothing left', 'entry'),
        ('title', 'The title'),
        ('title: none', 'stem'),
    ],
    "tree_scan": [
        ('.env', 8, None, True),
        ('.github/b.yml', 5, None, True),
        ('big.txt', 60, None, False),
        ('inner/.git/HEAD', 1, 'inner', True),
        ('inner/deep/z.py', 5, 'inner', True),
        ('key.pem', 6, None, False),
        ('node_modules/p/.git/x', 0, None, True),
        ('node_modules/p/m.js', 0, None, True),
        ('src/a.py', 6, None, True),
    ],
    "usage_report": [
        (0, '4 calls across 3 week(s)'),
        (1, ''),
        (2, 'week         calls   context/call   new-read/call   out/call'),
        (3, '2024-w1           2            400               0         10'),
        (4, '2024-w2           1            900               0         10'),
        (5, '2024-w3           1            200               0         10'),
        (6, ''),
        (7, 'before        2 calls   context/call        400   new-read/call         0'),
        (8, 'after         1 calls   context/call        200   new-read/call         0'),
        (9, 'change  -50.0% context, +0.0% new material per call: an observation, not an experiment'),
    ],
    "watch_scripts": [
        ('r', '2024-01-03T10:00:00', '2024-01-01', 3),
    ],
    "workspace_settings": [
        ('agents', 'false'),
        ('capture', 'true'),
        ('index_token_budget', '60'),
        ('language', '"en"'),
        ('log_retention_days', '7'),
        ('map', 'true'),
        ('memory', 'true'),
        ('milestones', 'true'),
        ('promote', 'true'),
        ('reply_style', '"terse"'),
        ('report', 'true'),
        ('resume', 'true'),
        ('session_retention_days', '30'),
        ('state', 'true'),
        ('warn_on_bulk_reads', 'true'),
    ],
}
