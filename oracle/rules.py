"""One SQL statement per query, for DuckDB over the same Parquet tables."""

from __future__ import annotations

from oracle import inputs as i

ORACLE: dict[str, str] = {}


def rule(name: str, ctes: str, select: str, *more: str) -> None:
    """Register ``select`` over the common table expressions."""
    ORACLE[name] = "WITH RECURSIVE " + ", ".join([ctes, *more]) + "\n" + select


# -- files ----------------------------------------------------------------

rule("asset_assemble", i.ASSETS, "SELECT path, mime_type, n_chunks, content FROM assets")
rule(
    "asset_assemble_carry_over", i.CHUNKS,
    """SELECT path, arg_max(mime_type, seq) AS mime_type, count(*) AS n_chunks,
         string_agg(chunk, '' ORDER BY seq) AS content
       FROM asset_chunks c JOIN ends USING (path)
       WHERE seq = done OR (seq < done AND NOT complete) GROUP BY path""",
    "ends AS (SELECT path, max(seq) AS done FROM asset_chunks WHERE complete GROUP BY path)",
)
rule(
    "asset_pending", i.SESSIONS,
    """SELECT path, count(*) AS n_chunks FROM sessions GROUP BY path, session
       HAVING NOT bool_or(complete)""",
)
rule("asset_list", i.SIZED, "SELECT path, mime_type, size, size_label FROM labelled ORDER BY path")
for _name in ("asset_get", "asset_get_stored"):
    rule(
        _name, i.ASSETS,
        "SELECT k.path, mime_type, n_chunks, content FROM lookup_keys k LEFT JOIN assets a ON a.path = k.path",
        i.LOOKUP_KEYS,
    )
_PAGES = """pages_of AS (
  SELECT path, mime_type, chunk, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY path) AS n
  FROM (SELECT s.path, f.mime_type, s.chunk, s.seq, s.session, max(s.session) OVER (PARTITION BY s.path) AS newest
        FROM sessions s JOIN finished_sessions f USING (path, session))
  WHERE session = newest WINDOW w AS (PARTITION BY path ORDER BY seq))"""
rule(
    "asset_pages", i.ASSETS,
    """SELECT path, mime_type, chunk_index, chunk, CASE WHEN chunk_index + 1 < n THEN chunk_index + 1 END AS next_index
       FROM pages_of""",
    _PAGES,
)
rule(
    "recognition_input", i.ASSETS,
    "SELECT path, mime_type, chunk, n > 1 AS cut_off FROM pages_of WHERE chunk_index = 0",
    _PAGES,
)
rule(
    "asset_delete", i.ASSETS,
    "SELECT path, mime_type, n_chunks, content FROM assets WHERE path NOT IN (SELECT path FROM delete_paths)",
    i.DELETE_PATHS,
)
rule(
    "asset_delete_pending", i.SESSIONS,
    """SELECT path, count(*) AS n_chunks FROM sessions WHERE path NOT IN (SELECT path FROM delete_paths)
       GROUP BY path, session HAVING NOT bool_or(complete)""",
    i.DELETE_PATHS,
)
rule(
    "chunk_split", i.DOCS,
    f"""SELECT path, {i._MIME.format(n='doc_id')} AS mime_type, i::INTEGER AS chunk_index,
         substr(text, i * 700 + 1, 700) AS chunk, i + 1 = n AS complete,
         round((i + 1)::DOUBLE / n * 100, 9) AS progress_pct
       FROM pieces""",
    """pieces AS (SELECT *, unnest(range(0, n)) AS i
       FROM (SELECT *, (length(text) + 699) // 700 AS n FROM docs))""",
)
rule(
    "doc_id_assign", i.CHUNKS,
    "SELECT path, seq, row_number() OVER (ORDER BY seq) - 1 AS doc_id FROM asset_chunks",
)
rule(
    "upload_guard", i.PAYLOADS,
    """SELECT payload_id, doc_type, CASE WHEN coalesce(length(content), 0) = 0 THEN 'No image data provided'
         WHEN length(content) >= 100 OR doc_type = 'passport' THEN NULL
         WHEN doc_type = 'live' THEN 'Data too small to be a valid image'
         ELSE 'Data too small to be a valid image: ' || length(content) || ' bytes' END AS guard_error
       FROM payloads""",
)
rule("image_files", i.SIZED, "SELECT path, mime_type, size FROM sized WHERE mime_type LIKE 'image/%'")

# -- stored results -------------------------------------------------------

LATEST = "SELECT doc_type, path, seq, result_json FROM latest"
rule("result_upsert", i.RESULTS, LATEST)
rule("result_upsert_stream", i.RESULTS, LATEST)
ORACLE["outcall_results"] = """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'passport' END AS doc_type,
    'uploads/' || (c_custkey // 3) || '.jpg' AS path, c_custkey AS seq,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 11 = 3 THEN '{"status":"error","message":"HTTP outcall failed","data":null}'
      WHEN c_custkey % 13 = 4 THEN '{"status":"error","message":"Failed to decode OCR response","data":null}'
      WHEN c_custkey % 17 = 2 THEN '' ELSE '{"n":' || c_custkey || '}' END AS result_json
  FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 2, c_custkey // 3 ORDER BY c_custkey DESC) = 1"""
rule("result_list", i.RESULTS, LATEST + " ORDER BY doc_type, path")
for _name in ("result_get", "result_get_stored"):
    rule(
        _name, i.RESULTS,
        "SELECT k.doc_type, k.path, result_json FROM result_keys k LEFT JOIN latest USING (doc_type, path)",
    )
rule(
    "result_counts", i.RESULTS,
    """SELECT store, count(doc_type) AS n FROM (VALUES ('id'), ('passport')) AS v(store)
         LEFT JOIN latest ON doc_type = store GROUP BY store
       UNION ALL SELECT 'documents', count(DISTINCT path) FROM asset_chunks WHERE complete""",
    i.CHUNKS,
)
rule(
    "result_delete", i.RESULTS,
    LATEST + " WHERE NOT EXISTS (SELECT 1 FROM result_keys k WHERE k.doc_type = latest.doc_type AND k.path = latest.path)",
)
rule(
    "result_summary", i.RESULTS,
    """SELECT doc_type, path, json_extract_string(doc, '$.processing_time')::DOUBLE AS processing_time,
         CASE WHEN doc IS NULL THEN NULL
           WHEN doc_type = 'id' THEN coalesce(nullif(json_extract_string(doc, '$.extracted_data.full_name'), ''), 'N/A')
           ELSE coalesce(json_extract_string(doc, '$.data.surname'), '') || ' '
             || coalesce(json_extract_string(doc, '$.data.name'), '') END AS name,
         CASE WHEN doc IS NULL THEN NULL
           ELSE coalesce(nullif(CASE WHEN doc_type = 'id' THEN json_extract_string(doc, '$.extracted_data.national_id')
             ELSE json_extract_string(doc, '$.data.passport_number') END, ''), 'N/A') END AS document_no,
         CASE WHEN doc IS NULL THEN 'Error parsing ' || path END AS parse_error
       FROM (SELECT *, CASE WHEN json_valid(result_json) THEN result_json::JSON END AS doc FROM latest)""",
)
rule(
    "artifact_unpivot", i.RESULTS,
    """SELECT doc_type, path, artifact_kind, json_extract_string(result_json, '$.debug_info.' || key) AS filename
       FROM (SELECT * FROM latest WHERE json_valid(result_json)) CROSS JOIN (VALUES
         ('preprocessed_image', 'preprocessed_image_path'), ('annotated_detection', 'debug_image_path'),
         ('cropped_document', 'cropped_image_path'), ('detector_output', 'yolo_output_path'),
         ('mrz_region', 'mrz_roi_path')) AS v(artifact_kind, key)
       WHERE json_extract_string(result_json, '$.debug_info.' || key) IS NOT NULL""",
)


def _quoted(column: str) -> str:
    return f"""'"{column}":"' || {column} || '"'"""


_PASSPORT_DATA = " || ',' || ".join(
    _quoted(c) for c in (
        "surname", "name", "sex", "date_of_birth", "nationality", "passport_type",
        "passport_number", "issuing_country", "expiration_date",
    )
)


_PASSPORT_DEBUG = """CASE WHEN zone_found
  THEN '"debug_info":{"mrz_detected":true,"mrz_roi_path":"mrz_roi.jpg","error":null}'
  ELSE '"debug_info":{"mrz_detected":false,"mrz_roi_path":null,"error":"No MRZ detected"}' END"""
_READ_ERROR = """CASE WHEN NOT zone_found THEN 'Could not detect Machine Readable Zone (MRZ) in the image'
  WHEN line1 IS NULL OR line2 IS NULL THEN 'Insufficient OCR results: Expected 2 MRZ lines' END AS read_error"""


def _passport_json(error: str, key: str) -> str:
    """Text of a passport envelope as the writer lays it out."""
    return f"""CASE WHEN {error} IS NULL
      THEN '{{"success":true,"processing_time":' || (({key} % 40)::DOUBLE / 4) || ',"data":{{' || {_PASSPORT_DATA}
        || '}},"error":null,' || {_PASSPORT_DEBUG} || '}}'
      ELSE '{{"success":false,"processing_time":' || (({key} % 40)::DOUBLE / 4) || ',"data":null,"error":"' || {error}
        || '",' || {_PASSPORT_DEBUG} || '}}' END"""


rule(
    "envelope_write", i.PASSPORTS,
    f"""SELECT 'passport' AS doc_type, 'passports/' || passport_id || '.jpg' AS path, passport_id AS seq,
         {_passport_json('read_error', 'passport_id')} AS result_json
       FROM passports JOIN (SELECT passport_id, zone_found, {_READ_ERROR} FROM mrz_lines) USING (passport_id)""",
)
rule(
    "passport_results", i.NAMED_PASSPORTS,
    f"""SELECT 'passport' AS doc_type, 'passports/' || (passport_id // 2) || '.jpg' AS path, passport_id AS seq,
         {_passport_json('read_error', 'passport_id')} AS result_json
       FROM named_passports JOIN (SELECT passport_id, zone_found, {_READ_ERROR} FROM mrz_lines) USING (passport_id)
       QUALIFY row_number() OVER (PARTITION BY passport_id // 2 ORDER BY passport_id DESC) = 1""",
)

# -- documents ------------------------------------------------------------

for _name in ("decode_national_id", "decode_national_id_sql"):
    rule(
        _name, i.DECODED,
        """SELECT person_id, id_number, birth_date, governorate_code, gender, decode_status,
             try_cast(CASE WHEN decode_status = 'ok' THEN birth_date END AS DATE)::VARCHAR AS birth_date_valid FROM decoded""",
    )
rule(
    "governorate_lookup", i.DECODED,
    """SELECT person_id, governorate_code, coalesce(name, 'Unknown') AS governorate
       FROM decoded LEFT JOIN governorates ON code = governorate_code""",
    i.GOVERNORATES,
)
rule("mrz_parse", i.PASSPORTS, "SELECT * FROM passports")
rule(
    "mrz_clean", i.MRZ_LINES,
    "SELECT passport_id, upper(regexp_replace(line1, '[^A-Za-z0-9]', '', 'g')) AS cleaned FROM mrz_lines",
)
rule(
    "mrz_sex", i.MRZ_LINES,
    """SELECT passport_id, line2[21] AS code, CASE line2[21] WHEN 'M' THEN 'M' WHEN 'm' THEN 'M' WHEN '0' THEN 'M'
         ELSE CASE WHEN line2 IS NOT NULL THEN 'F' END END AS sex FROM mrz_lines""",
)
rule(
    "mrz_date", i.MRZ_LINES,
    f"""SELECT passport_id, raw, {i.mrz_date('raw')} AS date_text,
         CASE WHEN {i.mrz_date('raw')} = raw OR raw[1:2]::INTEGER <= 30 THEN {i.mrz_date('raw')}
           WHEN try_strptime('19' || raw, '%Y%m%d') IS NULL THEN raw
           ELSE strftime(try_strptime('19' || raw, '%Y%m%d'), '%d/%m/%Y') END AS pivoted
       FROM (SELECT passport_id, line2[14:19] AS raw FROM mrz_lines)""",
)
rule(
    "country_lookup", i.NAMED_PASSPORTS,
    "SELECT passport_id, nationality, issuing_country FROM named_passports",
)
rule("passport_records", i.NAMED_PASSPORTS, "SELECT * FROM named_passports")
rule(
    "doc_type_dispatch", i.DECODED,
    """SELECT person_id * 2 AS payload_id, 'id' AS route, id_number AS document_no, birth_date, gender,
         coalesce(g.name, 'Unknown') AS governorate, decode_status, NULL::VARCHAR AS surname,
         NULL::VARCHAR AS nationality, NULL::VARCHAR AS parse_error
       FROM decoded LEFT JOIN governorates g ON code = governorate_code
       UNION ALL
       SELECT passport_id * 2 + 1, 'passport', passport_number, date_of_birth, sex, NULL, NULL, surname,
         nationality, parse_error FROM passports""",
    i.GOVERNORATES, i.PASSPORTS,
)


def _patchy(name: str, shift: int) -> str:
    return f"CASE WHEN (c_custkey + {shift}) % 7 < 2 THEN 'Unknown' ELSE '{name}-' || c_custkey END AS {name}"


ORACLE["record_defaults"] = (
    "SELECT c_custkey AS person_id, "
    + ", ".join(_patchy(n, k) for k, n in enumerate(i.RECORD_FIELDS[:-1]))
    + ", CASE WHEN (c_custkey + 9) % 7 < 2 THEN NULL ELSE 'face_image-' || c_custkey END AS face_image FROM customer"
)
rule(
    "detection_rate", i.STRUCTURED,
    """SELECT doc_id, rate, CASE WHEN rate >= 80 THEN 'high' WHEN rate >= 60 THEN 'medium' ELSE 'low' END AS band
       FROM (SELECT doc_id, floor(CASE document_type WHEN 'national-id'
           THEN (has_name::INT + has_id::INT + has_birth::INT + has_nation::INT)::DOUBLE / 4
           ELSE (has_name::INT + has_number::INT + has_birth::INT + has_nation::INT + has_expiry::INT)::DOUBLE / 5
         END * 100 + 0.5::DOUBLE)::BIGINT AS rate FROM structured)""",
)

# -- detections -----------------------------------------------------------

rule(
    "detection_filter", i.DETECTIONS,
    """SELECT image_id, l_linenumber, l_partkey, l_suppkey, class_name, confidence FROM det
       WHERE confidence >= (CASE class_name WHEN 'card' THEN 0.5 WHEN 'photo' THEN 0.4 ELSE 0.3 END)::DOUBLE""",
)
rule(
    "orientation_score", i.ANGLES,
    """SELECT image_id, angle, field_count, round(avg_conf, 9) AS avg_conf, round(score, 9) AS score, coalesce(fields, '') AS fields,
         "n_firstName", "n_lastName", n_nid, n_address, n_serial FROM orientation""",
)
rule("orientation_best", i.ANGLES, "SELECT image_id, angle, round(score, 9) AS score FROM best")
rule(
    "field_counts", i.KEPT,
    """SELECT i.image_id, count(*) FILTER (class_name = 'firstName') AS "firstName",
         count(*) FILTER (class_name = 'lastName') AS "lastName", count(*) FILTER (class_name = 'nid') AS nid,
         count(*) FILTER (class_name = 'address') AS address, count(*) FILTER (class_name = 'serial') AS serial
       FROM images i LEFT JOIN kept k ON k.image_id = i.image_id GROUP BY i.image_id""",
)
rule(
    "field_presence", i.PRESENCE,
    """SELECT image_id, f2::INT + f3::INT + f4::INT + f5::INT AS required_found, f1::INT AS optional_found,
         f1::INT + f2::INT + f3::INT + f4::INT + f5::INT AS fields_found, f2 AND f3 AND f4 AND f5 AS all_required
       FROM presence""",
)
rule(
    "avg_confidence", i.KEPT,
    """SELECT i.image_id, coalesce(printf('%.3f', sum(printf('%.3f', confidence)::DECIMAL(18, 3))::DOUBLE / count(confidence))::DOUBLE, 0)
         AS avg_confidence
       FROM images i LEFT JOIN kept k ON k.image_id = i.image_id GROUP BY i.image_id""",
)
rule(
    "missing_fields", i.PRESENCE,
    """SELECT image_id,
         array_to_string(list_filter([CASE WHEN NOT f1 THEN 'firstName' END, CASE WHEN NOT f2 THEN 'lastName' END,
           CASE WHEN NOT f3 THEN 'nid' END, CASE WHEN NOT f4 THEN 'address' END,
           CASE WHEN NOT f5 THEN 'serial' END], lambda v: v IS NOT NULL), ',') AS missing,
         array_to_string(list_filter([CASE WHEN NOT f2 THEN 'Last Name' END, CASE WHEN NOT f3 THEN 'National ID' END,
           CASE WHEN NOT f4 THEN 'Address' END, CASE WHEN NOT f5 THEN 'Serial' END],
           lambda v: v IS NOT NULL)[1:3], ',') AS missing_labels
       FROM presence""",
)
rule("digit_assemble", i.DETECTIONS, "SELECT image_id, id_number, n_digits FROM numbers", i.DIGITS)

_LAST = """coalesce(arg_max(text, det_seq) FILTER (class_name = 'firstName'), '') AS first_name,
  coalesce(arg_max(text, det_seq) FILTER (class_name = 'lastName'), '') AS second_name,
  coalesce(arg_max(text, det_seq) FILTER (class_name = 'nid'), '') AS nid,
  coalesce(arg_max(text, det_seq) FILTER (class_name = 'address'), '') AS address,
  coalesce(arg_max(text, det_seq) FILTER (class_name = 'serial'), '') AS serial"""
rule(
    "field_last_wins", i.KEPT,
    "SELECT *, first_name || ' ' || second_name AS full_name FROM last_rows",
    f"""last_rows AS (SELECT i.image_id, {_LAST} FROM images i LEFT JOIN kept k ON k.image_id = i.image_id
      GROUP BY i.image_id)""",
)


def _boxes(prefix: str, pick: str, name: str) -> str:
    return ", ".join(
        f"{pick}({c}, det_seq) FILTER (class_name = '{name}') AS {prefix}_{c}" for c in ("x1", "y1", "x2", "y2")
    )


_FIRST = ", ".join(
    [_boxes("nid", "arg_min", "nid"), _boxes("card", "arg_min", "card"), _boxes("crop", "arg_max", "card")]
)
rule(
    "field_first_wins", i.DETECTIONS,
    f"""SELECT i.image_id, {_FIRST},
         CASE WHEN count(*) FILTER (class_name = 'card') = 0 THEN 'No ID card detected' END AS error
       FROM images i LEFT JOIN det d ON d.image_id = i.image_id GROUP BY i.image_id""",
)

_KEYS = "image_id, l_linenumber, l_partkey, l_suppkey"
rule(
    "bbox_expand", i.DETECTIONS,
    f"""SELECT {_KEYS}, greatest(c - trunc(h * 1.5::DOUBLE)::INTEGER // 2, 0) AS y1,
         least(c + trunc(h * 1.5::DOUBLE)::INTEGER // 2, img_height) AS y2
       FROM (SELECT * EXCLUDE (y1, y2), y2 - y1 AS h, y1 + (y2 - y1) // 2 AS c FROM det)""",
)
rule(
    "bbox_pad_card", i.DETECTIONS,
    f"""SELECT {_KEYS}, greatest(0, x1 - greatest(10, trunc((x2 - x1) * 0.05::DOUBLE)::INTEGER)) AS x1,
         greatest(0, y1 - greatest(20, trunc((y2 - y1) * 0.1::DOUBLE)::INTEGER)) AS y1,
         least(img_width, x2 + greatest(10, trunc((x2 - x1) * 0.05::DOUBLE)::INTEGER)) AS x2,
         least(img_height, y2 + greatest(50, trunc((y2 - y1) * 0.15::DOUBLE)::INTEGER)) AS y2,
         greatest(0, x1 - 20) AS live_x1, greatest(0, y1 - 20) AS live_y1,
         least(img_width, x2 + 20) AS live_x2, least(img_height, y2 + 20) AS live_y2 FROM det""",
)
rule(
    "bbox_globalize", i.DETECTIONS,
    f"""SELECT {_KEYS}, x1, y1, x2, y2, printf('%.3f', x1::DOUBLE / img_width)::DOUBLE AS x1_norm,
         printf('%.3f', y1::DOUBLE / img_height)::DOUBLE AS y1_norm, printf('%.3f', x2::DOUBLE / img_width)::DOUBLE AS x2_norm,
         printf('%.3f', y2::DOUBLE / img_height)::DOUBLE AS y2_norm, x2 - x1 AS width, y2 - y1 AS height
       FROM (SELECT * REPLACE ((x1 + l_suppkey % 40)::INTEGER AS x1, (y1 + l_partkey % 30)::INTEGER AS y1,
         (x2 + l_suppkey % 40)::INTEGER AS x2, (y2 + l_partkey % 30)::INTEGER AS y2) FROM det)""",
)
rule(
    "photo_region", i.DETECTIONS,
    f"""SELECT {_KEYS}, x1, y1, x1 + w AS x2, y1 + h AS y2, printf('%.3f', x1::DOUBLE / 800)::DOUBLE AS x1_norm,
         printf('%.3f', y1::DOUBLE / 600)::DOUBLE AS y1_norm, printf('%.3f', (x1 + w)::DOUBLE / 800)::DOUBLE AS x2_norm,
         printf('%.3f', (y1 + h)::DOUBLE / 600)::DOUBLE AS y2_norm, w AS width, h AS height
       FROM (SELECT *, trunc((x2 - x1) * 0.3::DOUBLE)::INTEGER AS w, y2 - y1 AS h FROM (SELECT * REPLACE (
         greatest(0, x1 - 20) AS x1, greatest(0, y1 - 20) AS y1, least(800, x2 + 20) AS x2, least(600, y2 + 20) AS y2)
         FROM det))""",
)
rule(
    "nid_band", i.DETECTIONS,
    f"""SELECT {_KEYS}, greatest(0, y1 - trunc((y2 - y1) * 0.25::DOUBLE)::INTEGER) AS y1,
         least(img_height, y2 + trunc((y2 - y1) * 0.25::DOUBLE)::INTEGER) AS y2 FROM det""",
)
rule(
    "confidence_band", i.DETECTIONS,
    f"""SELECT {_KEYS}, CASE WHEN confidence > 0.8::DOUBLE THEN 'green' WHEN confidence > 0.6::DOUBLE THEN 'yellow'
         ELSE 'red' END AS band,
         printf('%.1f', confidence * 100) || '%' AS pct_label
       FROM det""",
)

# -- sizes, paths, phones -------------------------------------------------

rule(
    "resize_plan", i.FILE_SIZES,
    """SELECT p_partkey,
         CASE WHEN action = 'shrink' THEN greatest(400, CASE WHEN width > height THEN 1000
                ELSE trunc(width * (1000::DOUBLE / height))::INTEGER END)
           WHEN action = 'enlarge' THEN trunc(width * greatest(400::DOUBLE / width, 300::DOUBLE / height))::INTEGER
           ELSE width END AS new_width,
         CASE WHEN action = 'shrink' THEN greatest(300, CASE WHEN width > height
                THEN trunc(height * (1000::DOUBLE / width))::INTEGER ELSE 1000 END)
           WHEN action = 'enlarge' THEN trunc(height * greatest(400::DOUBLE / width, 300::DOUBLE / height))::INTEGER
           ELSE height END AS new_height, action
       FROM (SELECT *, CASE WHEN width > 1500 OR height > 1500 THEN 'shrink'
         WHEN width < 400 OR height < 300 THEN 'enlarge' ELSE 'keep' END AS action FROM file_sizes)""",
)
rule(
    "compress_plan", i.FILE_SIZES,
    """SELECT p_partkey, needs, recommended, target_kb, max_w, max_h, quality, reason,
         CASE WHEN bytes > 0 THEN round((1 - (bytes // 3)::DOUBLE / bytes) * 100, 6) END AS saved_pct,
         CASE WHEN bytes // 3 > 0 THEN round(bytes::DOUBLE / (bytes // 3), 6) END AS shrink_factor,
         CASE WHEN bytes > 0 THEN round((bytes // 3)::DOUBLE / bytes, 6) END AS kept_share,
         round(CASE WHEN width <= max_w AND height <= max_h THEN width::DOUBLE
           WHEN width > height THEN least(max_w, width)::DOUBLE
           ELSE least(max_h, height) * (width::DOUBLE / height) END, 6) AS fit_w,
         round(CASE WHEN width <= max_w AND height <= max_h THEN height::DOUBLE
           WHEN width > height THEN least(max_w, width) / (width::DOUBLE / height)
           ELSE least(max_h, height)::DOUBLE END, 6) AS fit_h
       FROM plans""",
    # What files of each size are compressed to.
    """tiers(above, up_to, target_kb, side, quality, reason) AS (VALUES
      (-1, 1048576, 1000, 1600, 0.9::DOUBLE, 'Image size is acceptable. No compression needed.'),
      (1048576, 2097152, 1000, 1400, 0.85::DOUBLE, 'Image is moderately large (>1MB). Light compression recommended.'),
      (2097152, 4194304, 800, 1200, 0.8::DOUBLE, 'Image is large (>2MB). Compression recommended.'),
      (4194304, NULL, 500, 1000, 0.7::DOUBLE, 'Image is very large (>4MB). Strong compression recommended.')
    ), plans AS (
      SELECT f.*, bytes > 1024000 AS needs, mb > 1 AS recommended,
        target_kb, side AS max_w, side AS max_h, quality, reason
      FROM (SELECT *, bytes / 1048576.0::DOUBLE AS mb FROM file_sizes) f
        JOIN tiers ON bytes > above AND (up_to IS NULL OR bytes <= up_to))""",
)
rule("path_sanitize", i.PATHS, "SELECT page_id, clean FROM clean_paths")
rule(
    "path_valid", i.PATHS,
    """SELECT page_id, regexp_full_match(path, '[a-zA-Z0-9\\-_./]+') AND instr(path, '..') = 0
         AND path[1] <> '/' AND path[-1] <> '/' AS raw_ok,
         regexp_full_match(clean, '[a-zA-Z0-9\\-_./]+') AND instr(clean, '..') = 0
         AND clean[1] <> '/' AND clean[-1] <> '/' AS clean_ok FROM clean_paths""",
)
for _name in ("phone_mask", "phone_mask_sql"):
    rule(
        _name, i.PHONES,
        """SELECT event_id, CASE WHEN length(phone) <= 4 THEN phone
             ELSE regexp_replace(phone[1:length(phone) - 4], '[0-9]', '*', 'g') || right(phone, 4) END AS masked
           FROM phones""",
    )

# -- quality and capture --------------------------------------------------

_UNREAD = "CASE WHEN broken THEN 'Could not load image' END AS error"
rule(
    "image_quality", i.IMAGES,
    f"SELECT rated.* REPLACE (i.image_id AS image_id), {_UNREAD} FROM images i LEFT JOIN rated ON rated.image_id = i.image_id",
)
rule(
    "photo_variance", i.IMAGES,
    f"""SELECT image_id, round(variance, 9) AS variance, CASE WHEN NOT broken THEN detected END AS detected,
         CASE WHEN detected THEN variance > 200 END AS is_clear, {_UNREAD} FROM photos""",
)
rule(
    "image_rows_quality", i.IMAGES,
    f"""SELECT p.image_id, quality_score, blur_score, CASE WHEN NOT broken THEN card_found END AS card_found,
         round(variance, 9) AS variance, CASE WHEN NOT broken THEN detected END AS detected, {_UNREAD}
       FROM photos p LEFT JOIN rated ON rated.image_id = p.image_id""",
)
rule("capture_ready", i.FRAMES, "SELECT frame_id, fields_found, n_digits, ready_for_capture FROM ready")
rule("capture_message", i.FRAMES, "SELECT frame_id, message FROM messages")
_PICK = """SELECT session_id, frame_id, epoch_us(ts) AS micros FROM ready WHERE ready_for_capture
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) = 1"""
rule("capture_pick", i.FRAMES, _PICK)
rule("capture_stream", i.FRAMES, _PICK)
rule(
    "capture_readiness", i.FRAMES,
    """SELECT frame_id, session_id, required_found, optional_found, fields_found, n_detections, n_digits,
         printf('%.3f', mean_confidence)::DOUBLE AS confidence, photo_detected, quality_level, ready_for_capture, message
       FROM messages""",
)

_SHOTS = """frames AS (
  SELECT event_id AS frame_id, user_id AS session_id, ts, coalesce(variance, 0) AS photo_variance, card_found,
    rated.* EXCLUDE (image_id), photos.* EXCLUDE (image_id, card_found)
  FROM events LEFT JOIN photos ON photos.image_id = event_id LEFT JOIN rated ON rated.image_id = event_id
), """ + i.FRAME_RULES
rule(
    "capture_from_pixels", i.IMAGES,
    """SELECT frame_id, CASE WHEN quality_level IS NULL THEN 'Could not load image' END AS error, quality_level,
         CASE WHEN quality_level IS NOT NULL THEN photo_detected END AS photo_detected,
         CASE WHEN quality_level IS NOT NULL THEN ready_for_capture END AS ready_for_capture,
         CASE WHEN quality_level IS NOT NULL THEN message END AS message
       FROM messages""",
    _SHOTS,
)


def _photo_box(**sides: str) -> str:
    return ", ".join(f"CASE WHEN shown THEN {c} END AS photo_{name}" for name, c in sides.items())


rule(
    "capture_result", i.IMAGES,
    f"""SELECT frame_id, session_id, read AND n_detections > 0 AS detected,
         CASE WHEN NOT read THEN 'Could not load image' END AS error, CASE WHEN read THEN photo_detected END AS photo_detected,
         {_photo_box(
             x1='crop_x1', y1='crop_y1', x2='crop_x1 + w', y2='crop_y2',
             x1_norm="printf('%.3f', crop_x1::DOUBLE / frame_w)::DOUBLE", y1_norm="printf('%.3f', crop_y1::DOUBLE / frame_h)::DOUBLE",
             x2_norm="printf('%.3f', (crop_x1 + w)::DOUBLE / frame_w)::DOUBLE", y2_norm="printf('%.3f', crop_y2::DOUBLE / frame_h)::DOUBLE",
             width='w', height='crop_y2 - crop_y1', is_clear='variance > 200', variance='round(variance, 9)',
         )},
         CASE WHEN read THEN fields_found ELSE 0 END AS field_count, CASE WHEN read THEN n_detections END AS total_detections,
         CASE WHEN read THEN printf('%.3f', mean_confidence)::DOUBLE END AS confidence, quality_score, quality_level, blur_score,
         brightness, is_blurry, is_too_dark, is_too_bright, size_ok, width, height, feedback,
         CASE WHEN read THEN ready_for_capture END AS ready_for_capture, CASE WHEN read THEN message END AS message,
         CASE WHEN read THEN coalesce(c1, 0) END AS "n_firstName", CASE WHEN read THEN coalesce(c2, 0) END AS "n_lastName",
         CASE WHEN read THEN coalesce(c3, 0) END AS n_nid, CASE WHEN read THEN coalesce(c4, 0) END AS n_address,
         CASE WHEN read THEN coalesce(c5, 0) END AS n_serial
       FROM (SELECT *, quality_level IS NOT NULL AS read, quality_level IS NOT NULL AND photo_detected AS shown,
           trunc((crop_x2 - crop_x1) * 0.3::DOUBLE)::INTEGER AS w FROM messages) m
         LEFT JOIN class_counts USING (frame_id)""",
    _SHOTS,
    """class_counts AS (SELECT frame_id, count(*) FILTER (k = 1) AS c1, count(*) FILTER (k = 2) AS c2,
      count(*) FILTER (k = 3) AS c3, count(*) FILTER (k = 4) AS c4, count(*) FILTER (k = 5) AS c5
      FROM frame_fields WHERE confidence >= 0.3::DOUBLE GROUP BY frame_id)""",
)

# -- faces ----------------------------------------------------------------

_NO_FACE = """CASE WHEN NOT sent THEN 'Both id_image and live_image are required'
  WHEN NOT (has_id AND has_live) THEN 'Face not detected in one of the images' END"""
rule(
    "face_pair_join", i.FACES,
    f"""SELECT case_id, has_id, has_live, {_NO_FACE} AS error
       FROM faces""",
)
_COMPARED = f"""SELECT * FROM verified UNION ALL
  SELECT case_id, NULL, {_NO_FACE}, NULL, NULL, NULL FROM faces WHERE NOT (has_id AND has_live)"""
rule("face_similarity", i.FACES, _COMPARED)
rule("face_verification", i.FACES, _COMPARED)
rule(
    "face_response", i.FACES,
    f"""SELECT case_id, error IS NULL AS success, similarity_score, is_match, confidence,
         CASE WHEN error IS NULL THEN case_id * 0.5::DOUBLE + 1700000000 END AS request_timestamp, error
       FROM ({_COMPARED})""",
)

# -- one-time codes -------------------------------------------------------

_OUTCOMES = "SELECT event_id, phone, action, success, message FROM replay WHERE n > 0"
rule("otp_replay", i.OTP, _OUTCOMES)
rule("otp_stream", i.OTP, _OUTCOMES)
rule("verified_phones", i.OTP, "SELECT DISTINCT phone FROM replay WHERE action = 'verify' AND success")
_HELD = """SELECT phone, repeat('*', length(held)) AS code,
         greatest(0, (expiry - epoch_us(TIMESTAMP '2024-01-20 00:00:00')) // 1000000) AS remaining_secs
       FROM (SELECT * FROM replay WHERE n > 0 AND micros <= epoch_us(TIMESTAMP '2024-01-20 00:00:00')
         QUALIFY row_number() OVER (PARTITION BY phone ORDER BY n DESC) = 1)
       WHERE held IS NOT NULL"""
rule("otp_state", i.OTP, _HELD)
rule("otp_state_live", i.OTP, _HELD)

# -- ratings and cases ----------------------------------------------------

rule("rating_latest", i.RATINGS, "SELECT doc_id, rating FROM latest_ratings ORDER BY doc_id")
rule(
    "rating_get", i.RATINGS,
    "SELECT d.doc_id, rating FROM documents d LEFT JOIN latest_ratings r ON r.doc_id = d.doc_id",
)
rule(
    "rating_join", i.SIZED,
    """SELECT position, path, mime_type, coalesce(rating, 0) AS rating,
         CASE rating WHEN 1 THEN 'Poor - Not suitable for OCR' WHEN 2 THEN 'Fair - Limited OCR accuracy'
           WHEN 3 THEN 'Good - Moderate OCR accuracy' WHEN 4 THEN 'Very Good - High OCR accuracy'
           WHEN 5 THEN 'Excellent - Perfect for OCR' ELSE 'No rating' END AS rating_label
       FROM (SELECT path, mime_type, row_number() OVER (ORDER BY path) - 1 AS position FROM sized
             WHERE mime_type LIKE 'image/%') LEFT JOIN latest_ratings ON doc_id = position""",
    i.RATINGS,
)
rule("status_latest", i.STATUS, "SELECT case_id, status FROM current_status")
rule(
    "status_steps", i.STATUS,
    """SELECT event_id, coalesce(document_done, false) AS document_done,
         coalesce(verification_done, false) AS verification_done, coalesce(otp_done, false) AS otp_done,
         coalesce(complete_done, false) AS complete_done,
         CASE WHEN greatest(event_id % 8, 1) >= 5 THEN 100
           ELSE floor((greatest(event_id % 8, 1) - 1)::DOUBLE / 4 * 85 + 0.5::DOUBLE)::BIGINT END AS progress_pct,
         CASE WHEN event_id % 7 <= 1 THEN 100
           ELSE floor((greatest(1, least(event_id % 7, event_id % 8)) - 1)::DOUBLE / (event_id % 7 - 1) * 100
             + 0.5::DOUBLE)::BIGINT END AS stepper_pct
       FROM status_events LEFT JOIN steps USING (status)""",
    # The steps that each status has behind it.
    """steps(status, document_done, verification_done, otp_done, complete_done) AS (VALUES
      ('document_uploaded', true, false, false, false), ('document_verified', true, true, false, false),
      ('otp_verified', true, true, true, false), ('completed', true, true, true, true))""",
)
rule(
    "case_assemble", i.CASES,
    """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '+20' || lpad(c_custkey::VARCHAR, 10, '0') END AS phone,
         CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 4 = 0 THEN 'passport' ELSE 'national_id' END AS document_type,
         CASE WHEN c_custkey % 10 <> 3 THEN [3, 3, 3, 2, 2][c_custkey % 5 + 1] END AS n_fields,
         (SELECT value FROM scanned s WHERE s.case_id = c_custkey AND key = 'full_name') AS scanned_name,
         CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 6 = 0 THEN 'Edited ' || c_custkey END AS edited_name,
         CASE WHEN c_custkey % 8 <> 0 AND c_custkey % 7 <> 0 THEN 'face' || c_custkey END AS face_image,
         c_custkey % 8 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS face_verified,
         c_custkey % 8 <> 0 AND c_custkey % 5 = 0 AS face_skipped,
         c_custkey % 10 <> 3 AND c_custkey % 4 <> 0 AS documents_complete
       FROM customer WHERE c_custkey % 9 <> 0 OR c_custkey % 10 <> 3 OR c_custkey % 8 <> 0""",
)
rule("review_unpivot", i.CASES, "SELECT case_id, label, value FROM review")
rule(
    "case_review", i.CASES,
    """SELECT case_id, label, value, status, CASE case_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 21 WHEN 2 THEN 43
           WHEN 3 THEN 64 ELSE 100 END::BIGINT AS progress_pct
       FROM review LEFT JOIN current_status USING (case_id)""",
    i.STATUS,
)


def _fallback(keys: list[str], last: str = "''") -> str:
    tests = ", ".join(f"max(nullif(value, '')) FILTER (key = '{k}')" for k in keys)
    return f"coalesce({tests}, {last})"


_BUILT = (
    "trim(coalesce(max(value) FILTER (key IN ('first_name', 'firstName')), '') || ' ' "
    "|| coalesce(max(value) FILTER (key IN ('second_name', 'secondName')), ''))"
)
rule(
    "field_fallback", i.CASES,
    f"""SELECT case_id, {_fallback(['full_name', 'first_name', 'second_name', 'name'], _BUILT)} AS full_name,
         {_fallback(['national_id', 'id', 'national_id_number'])} AS national_id,
         {_fallback(['address', 'location', 'residence'])} AS address,
         {_fallback(['birth_date', 'date_of_birth', 'birthday'])} AS birth_date,
         {_fallback(['gender', 'sex'])} AS gender, {_fallback(['governorate', 'state', 'province'])} AS governorate,
         {_fallback(['full_name'], _BUILT)} AS built_name
       FROM scanned GROUP BY case_id""",
)

# -- records end to end ---------------------------------------------------

_RECORDS = i.ANGLES + ", " + i.DIGITS + f""", upright AS (
  SELECT b.image_id, b.angle, d.class_name, d.text, d.det_seq, d.confidence, d.x1, d.y1, d.x2, d.y2,
    d.l_linenumber, d.l_partkey, d.l_suppkey
  FROM best b LEFT JOIN det d ON d.image_id = b.image_id AND d.angle = b.angle
), cards AS (
  SELECT image_id, angle, count(*) FILTER (class_name = 'card') > 0 AS found, {_boxes('card', 'arg_max', 'card')}
  FROM upright GROUP BY image_id, angle
), usable AS (
  SELECT * FROM upright WHERE confidence >= 0.3::DOUBLE AND class_name IN ('firstName', 'lastName', 'nid', 'address', 'serial')
), texts AS (
  SELECT image_id, {_LAST}, string_agg('{{"class":"' || class_name || '","confidence":' || confidence || ',"bbox":['
      || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']}}', ',' ORDER BY det_seq) AS boxes
  FROM usable GROUP BY image_id
), last_numbers AS (
  SELECT image_id, id_number FROM usable JOIN box_numbers USING (image_id, l_linenumber, l_partkey, l_suppkey)
  WHERE class_name = 'nid' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY det_seq DESC) = 1
), read AS (
  SELECT c.*, coalesce(boxes, '') AS boxes, CASE WHEN found THEN coalesce(id_number, '') END AS national_id,
    CASE WHEN found THEN coalesce(first_name, '') END AS first_name,
    CASE WHEN found THEN coalesce(second_name, '') END AS second_name,
    CASE WHEN found THEN coalesce(address, '') END AS address, CASE WHEN found THEN coalesce(serial, '') END AS serial
  FROM cards c LEFT JOIN texts t ON t.image_id = c.image_id LEFT JOIN last_numbers n ON n.image_id = c.image_id
), judged AS (
  SELECT *, CASE WHEN coalesce(length(national_id), 0) < 14 THEN 'short'
    WHEN national_id[1] NOT IN ('2', '3') THEN 'bad_century' ELSE 'ok' END AS decode_status FROM read
), records AS (
  SELECT * EXCLUDE (card_x1, card_y1, card_x2, card_y2), CASE WHEN NOT found THEN 'No ID card detected' END AS error,
    first_name || ' ' || second_name AS full_name,
    CASE WHEN decode_status = 'ok' THEN CASE national_id[1] WHEN '2' THEN '19' ELSE '20' END || national_id[2:3] || '-'
      || national_id[4:5] || '-' || national_id[6:7] ELSE 'Unknown' END AS birth_date,
    CASE WHEN decode_status = 'ok' THEN coalesce((SELECT name FROM governorates WHERE code = national_id[8:9]), 'Unknown')
      ELSE 'Unknown' END AS governorate,
    CASE WHEN decode_status <> 'ok' THEN 'Unknown' WHEN national_id[13]::INTEGER % 2 = 1 THEN 'Male'
      ELSE 'Female' END AS gender,
    greatest(0, card_x1 - greatest(10, trunc((card_x2 - card_x1) * 0.05::DOUBLE)::INTEGER)) AS crop_x1,
    greatest(0, card_y1 - greatest(20, trunc((card_y2 - card_y1) * 0.1::DOUBLE)::INTEGER)) AS crop_y1,
    least(800, card_x2 + greatest(10, trunc((card_x2 - card_x1) * 0.05::DOUBLE)::INTEGER)) AS crop_x2,
    least(600, card_y2 + greatest(50, trunc((card_y2 - card_y1) * 0.15::DOUBLE)::INTEGER)) AS crop_y2
  FROM judged)"""
rule(
    "national_id_records", i.GOVERNORATES,
    """SELECT image_id, angle, error, full_name, national_id, birth_date, governorate, gender, address, serial,
         decode_status, CASE WHEN found THEN crop_x1 END AS crop_x1, CASE WHEN found THEN crop_y1 END AS crop_y1,
         CASE WHEN found THEN crop_x2 END AS crop_x2, CASE WHEN found THEN crop_y2 END AS crop_y2 FROM records""",
    _RECORDS,
)

_ID_DATA = " || ',' || ".join(
    _quoted(c) for c in (
        "first_name", "second_name", "full_name", "national_id", "address",
        "birth_date", "governorate", "gender", "serial",
    )
)
_STORED_IDS = _RECORDS + f""", stored AS (
  SELECT 'id' AS doc_type, 'cards/' || (image_id // 2) || '.jpg' AS path, image_id AS seq,
    CASE WHEN error IS NOT NULL THEN '{{"error":"' || error || '"}}'
      WHEN decode_status = 'bad_century' THEN '{{"error":"Invalid century digit"}}'
      ELSE '{{"success":true,"processing_time":' || ((image_id % 40)::DOUBLE / 4)
        || ',"method":"egyptian_id","extracted_data":{{' || {_ID_DATA} || ',"face_image":null}}'
        || ',"face_verification":{{"face_detected":false,"face_image":null,"face_error":"No face detected in ID image"}}'
        || ',"debug_info":{{"detected_fields":[' || boxes
        || '],"debug_image_path":"egyptian_id_debug.jpg","cropped_image_path":"cropped_id_card.jpg"'
        || ',"yolo_output_path":"d2.jpg","preprocessed_image_path":"preprocessed_image.jpg"}},"total_fields":8}}' END AS result_json
  FROM records QUALIFY row_number() OVER (PARTITION BY image_id // 2 ORDER BY image_id DESC) = 1)"""
rule("national_id_results", i.GOVERNORATES, "SELECT doc_type, path, seq, result_json FROM stored", _STORED_IDS)
rule(
    "national_id_summary", i.GOVERNORATES,
    """SELECT doc_type, path, CASE WHEN read THEN (seq % 40)::DOUBLE / 4 END AS processing_time,
         CASE WHEN read THEN full_name ELSE 'N/A' END AS name,
         CASE WHEN read AND national_id <> '' THEN national_id ELSE 'N/A' END AS document_no,
         NULL::VARCHAR AS parse_error
       FROM (SELECT s.*, full_name, national_id, error IS NULL AND decode_status <> 'bad_century' AS read
         FROM stored s JOIN records ON image_id = seq)""",
    _STORED_IDS,
)

# -- streams and images ---------------------------------------------------

rule("asset_stream", i.ASSETS, "SELECT path, mime_type, n_chunks, content FROM assets")
rule(
    "image_scan", i.PIXELS,
    """SELECT image_id, 8 AS height, 8 AS width, string_agg(repeat(printf('%02X', g), 3), '' ORDER BY y, x) AS pixels,
         NULL::VARCHAR AS error FROM pixels GROUP BY image_id""",
)
rule(
    "image_sizes", i.PIXELS,
    """SELECT image_id, width, height, NULL::VARCHAR AS error, (width * grow)::INTEGER AS new_width, (height * grow)::INTEGER AS new_height
       FROM (SELECT image_id, (max(x) + 1)::INTEGER AS width, (max(y) + 1)::INTEGER AS height,
               greatest(400::DOUBLE / (max(x) + 1), 300::DOUBLE / (max(y) + 1)) AS grow FROM pixels GROUP BY image_id)""",
)
rule(
    "apply_detector", i.PIXELS,
    """SELECT image_id, 'card' AS class_name, min(x)::INTEGER AS x1, min(y)::INTEGER AS y1, max(x)::INTEGER AS x2,
         max(y)::INTEGER AS y2
       FROM pixels JOIN (SELECT image_id, sum(g) AS total FROM pixels GROUP BY image_id) USING (image_id)
       WHERE g * 64 > total GROUP BY image_id""",
)
_TONED = """greyed AS (
  SELECT image_id, x, y, round_even(g * 0.114::DOUBLE + g * 0.587::DOUBLE + g * 0.299::DOUBLE, 0) AS g FROM pixels
), toned AS (
  SELECT image_id, x, y, round_even(least(255::DOUBLE, greatest(0::DOUBLE,
    (g + 10 - 128) * 1.2::DOUBLE + 128)), 0) AS g FROM greyed
), sharp AS (
  SELECT c.image_id, c.x, c.y, CASE WHEN c.x IN (0, 7) OR c.y IN (0, 7) THEN c.g ELSE round_even(least(255::DOUBLE,
    greatest(0::DOUBLE, 3 * c.g - 0.5::DOUBLE * (l.g + r.g + u.g + d.g))), 0) END::INTEGER AS g
  FROM toned c
  LEFT JOIN toned l ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x - 1
  LEFT JOIN toned r ON r.image_id = c.image_id AND r.y = c.y AND r.x = c.x + 1
  LEFT JOIN toned u ON u.image_id = c.image_id AND u.x = c.x AND u.y = c.y - 1
  LEFT JOIN toned d ON d.image_id = c.image_id AND d.x = c.x AND d.y = c.y + 1)"""
rule(
    "image_adjust", i.PIXELS,
    """SELECT image_id, 8 AS width, 8 AS height, string_agg(repeat(printf('%02X', g), 3), '' ORDER BY y, x) AS pixels
       FROM sharp GROUP BY image_id""",
    _TONED,
)
