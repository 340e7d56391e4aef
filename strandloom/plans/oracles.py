"""DuckDB SQL for the driver's queries over the sample tables: what each must return."""

from .sample_files import MAPS, TABLES_SQL, triples_sql

ORACLES = {
    # P3
    "header_kv_split": r"""
SELECT page_id, CASE WHEN strpos(url,'=')>0 THEN substr(url,1,strpos(url,'=')-1) ELSE url END AS header_key, CASE WHEN strpos(url,'=')>0 THEN substr(url,strpos(url,'=')+1) ELSE '' END AS header_value FROM pages
""",
    # P7
    "normalize_ws": r"""
SELECT doc_id, trim(regexp_replace(text,'[ \t\n\x0B\f\r]+',' ','g'),' ') AS norm FROM documents
""",
    # E3,E9
    "format_values_zip_outer": r"""
SELECT p_partkey, CAST(i AS INTEGER) AS format_index, coalesce(nullif(k[i],''),'FIELD_'||i) AS format_key, coalesce(v[i],'') AS format_value FROM (SELECT p_partkey, k, v, unnest(range(1,greatest(len(k),len(v))+1)) AS i FROM (SELECT p_partkey, string_split(p_brand||'::'||p_type,':') AS k, string_split(p_name||CASE WHEN p_size%3=0 THEN ' a b' ELSE '' END,' ') AS v FROM part))
""",
    # E7
    "sanitize_uri_id": r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(CASE WHEN page_id%10=0 THEN '//' ELSE url END,'[^A-Za-z0-9._~-]+','_','g'),'_'),''),'sample_'||page_id) AS uri_id FROM pages
""",
    # M1-M11,R1-R5
    "triples_nation_region": r"""
SELECT 'file://nation#'||n_nationkey AS s, 'rdf:type' AS p, 'v:Nation' AS o FROM nation UNION ALL SELECT 'file://nation#'||n_nationkey, 'v:name', n_name FROM nation UNION ALL SELECT 'file://nation#'||n_nationkey, 'v:inRegion', 'file://region#'||n_regionkey FROM nation UNION ALL SELECT 'file://region#'||r_regionkey, 'v:name', r_name FROM region
""",
    # R6 tier T2, parentTriplesMap
    "link_by_join": r"""
SELECT 'file://nation#'||n_nationkey AS s, 'v:inRegionName' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
""",
    # N5
    "null_typing": r"""
SELECT o_orderkey, CASE WHEN o_orderstatus='O' THEN '"."^^<v:Null>' ELSE '"'||o_orderstatus||'"' END AS o FROM orders
""",
    # N3,F13
    "part_dedupe": r"""
SELECT doc_id, h FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n=1
""",
    # N6
    "triple_count_rollup": r"""
SELECT coalesce(source,'TOTAL') AS source, count(*) AS n FROM (SELECT source, unnest(string_split(text,chr(10))) AS line FROM documents) WHERE regexp_matches(line,'^[ \t]*[^#].*\.[ \t]*$') GROUP BY ROLLUP(source)
""",
    # G1
    "method_aggregate": r"""
SELECT CASE WHEN event_type IN ('click','view') THEN 'ui' ELSE event_type END AS method, max(event_id) AS exit_code, round(sum(value) FILTER (WHERE event_type='click'),2) AS wall_seconds, CASE WHEN count(DISTINCT event_type)=1 THEN min(event_type) ELSE 'mixed' END AS source FROM events GROUP BY 1
""",
    # G3,G4
    "upsert": r"""
SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang='en') UNION ALL SELECT doc_id, CAST(9 AS INTEGER) FROM documents WHERE lang='en'
""",
    # G10
    "size_estimate": r"""
SELECT CAST(sum(CASE WHEN lang='en' THEN n_chars*5 ELSE n_chars END)*42 AS BIGINT) AS rdf_low, CAST(sum(CASE WHEN lang='en' THEN n_chars*5 ELSE n_chars END)*67 AS BIGINT) AS rdf_high FROM documents
""",
    # F1
    "elapsed_to_seconds": r"""
SELECT event_id, CAST(split_part(t,':',1) AS DOUBLE)*3600 + CAST(split_part(t,':',2) AS DOUBLE)*60 + CAST(split_part(t,':',3) AS DOUBLE) AS seconds FROM (SELECT event_id, strftime(ts,'%H:%M:%S') AS t FROM events)
""",
    # Z3'
    "dictionary_encode": r"""
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS term_id FROM orders
""",
    # N3 to N6 on the default mapping, T1
    "graph_triple_counts": TABLES_SQL + "SELECT p, count(*) AS n FROM (" + " UNION ALL ".join("SELECT split_part(value, ' ', 2)[2:-2] AS p FROM (" + triples_sql(m) + ")" for m in MAPS) + ") GROUP BY p",
    # Z3'
    "dictionary_round_trip": "SELECT DISTINCT value FROM (" + triples_sql("line") + ") UNION SELECT value FROM (" + triples_sql("record") + ")",
    # N1,N4,N7,K2
    "batch_layout": triples_sql("header-line"),
    # N2,N8,K2
    "aggregate_layout": triples_sql("file-record"),
    # Z1,Z6,S9
    "gzip_round_trip": triples_sql("sample"),
    # S5,S6,S7,E10,G11,K1
    "tables_round_trip": TABLES_SQL + "SELECT * FROM records",
    # S7
    "missing_tables": """
SELECT CAST(doc_id AS VARCHAR) AS prefix, 'header_lines' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'file_metadata' FROM documents WHERE lang IS DISTINCT FROM 'en'
""",
    # S10,G2
    "run_total_triples": "SELECT CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 3 < 2",
    # F6,F8
    "prefix_of_names": r"""
SELECT p_partkey, regexp_replace(name, '\.vcf(\.gz)?$', '') AS prefix, trim(regexp_replace('/' || name || '!', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS slug
FROM (SELECT p_partkey, p_name || ['.vcf', '.vcf.gz', '.VCF', '.vcf.bz2'][p_partkey % 4 + 1] AS name FROM part)
""",
    # F2
    "time_logs": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 * 3600.0 + o_orderkey % 60 * 60 + o_custkey % 60 ELSE o_orderkey + 0.5 END :: DOUBLE AS wall_seconds,
  (o_custkey + 0.25) :: DOUBLE AS user_seconds, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 + 0.5 ELSE 0 END :: DOUBLE AS sys_seconds, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS max_rss_kb FROM orders
""",
    # F3,F4
    "sizes_and_durations": """
SELECT o_orderkey, CASE WHEN b < 1024 THEN format('{} B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824.0) ELSE printf('%.2f TB', b / 1099511627776.0) END AS size,
  CASE WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%dm %.1fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) ELSE printf('%dh %dm %.1fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, s - floor(s / 60) * 60) END AS took
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1024 AS b, o_orderkey / 4.0 :: DOUBLE AS s FROM orders)
""",
    # F5
    "lenient_integers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 2 THEN p_partkey END AS n FROM part",
    # S1,S9,F7,F9,F10,F12,G6,Z9
    "names_and_methods": """
SELECT * FROM (VALUES ('is_vcf', 'a.vcf', 'True'), ('is_vcf', 'a.vcf.gz', 'True'), ('is_vcf', 'a.VCF', 'False'), ('is_vcf', 'a.vcf.bz2', 'False'),
  ('methods', '', '[]'), ('methods', 'none', '[]'), ('methods', 'gzip,gzip, hdt', '[''gzip'', ''hdt'']'), ('methods', 'zip', 'refused'),
  ('positive', '3', '3'), ('positive', '0', 'refused'), ('positive', '-1', 'refused'), ('positive', '1.5', 'refused'),
  ('format', 'a.nt.gz', 'gzip'), ('format', 'a.hdt.br', 'hdt_brotli'), ('format', 'a.hdt', 'hdt'), ('format', 'a.zip', 'refused'),
  ('decompressed', 'a.nt.gz', 'a.nt'), ('decompressed', 'a.hdt.gz', 'a.hdt'), ('decompressed', 'a.hdt', 'a.nt'), ('decompressed', 'a.br', 'a.nt'),
  ('safe', 'a b/c', 'a_b_c'), ('safe', '//', 'rdf'), ('safe', 'x.nt', 'x.nt'),
  ('columns', '', '23'), ('columns', 'gzip', '31'), ('columns', 'brotli', '31'), ('columns', 'hdt', '32'), ('columns', 'hdt_gzip', '38'), ('columns', 'hdt_brotli', '38'), ('columns', 'all', '56')) AS t(function, input, output)
""",
}
#: P1,P8,P9,P10,P11,P12,E1 and so on: the tables of the variant files; strict: positional samples.
ORACLES |= {f"vcf_{t}": TABLES_SQL + f"SELECT * FROM {t}" for t in ("records", "header_lines", "file_metadata", "sample_calls", "sample_format_values", "strict_calls")}
#: M1 to M11, R1 to R5
ORACLES |= {"map_" + m.replace("-", "_"): triples_sql(m) for m in MAPS}
