"""The input tables of ``kredenz.sources.tables`` as DuckDB common table expressions."""

DOCS = """docs AS (
  SELECT doc_id, text, source || '/' || doc_id ||
    CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '.pdf' END AS path
  FROM documents)"""

_MIME = """CASE ({n}) % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png'
  WHEN 2 THEN 'text/plain' ELSE 'application/pdf' END"""

CHUNKS = DOCS + f""", uploads AS (
  SELECT doc_id, path, 0 AS upload, text AS content, doc_id % 15 <> 4 AS finished FROM docs
  UNION ALL
  SELECT doc_id, path, 1, text || '#2', doc_id % 20 <> 10 FROM docs WHERE doc_id % 10 = 0
), slices AS (
  SELECT *, (length(content) - 1) // 1000 AS last_i,
         unnest(range(0, (length(content) - 1) // 1000 + 1)) AS i FROM uploads
), asset_chunks AS (
  SELECT path,
    CASE WHEN i = last_i THEN {_MIME.format(n='doc_id + upload')}
         ELSE 'application/octet-stream' END AS mime_type,
    doc_id * 1000000 + upload * 500000 + i AS seq,
    substr(content, i * 1000 + 1, 1000) AS chunk,
    (i = last_i AND finished) AS complete
  FROM slices)"""

# Running count of completed uploads before each chunk gives the upload a chunk is in.
SESSIONS = CHUNKS + """, sessions AS (
  SELECT *, coalesce(sum(complete::INT) OVER (PARTITION BY path ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session
  FROM asset_chunks)"""

ASSETS = SESSIONS + """, finished_sessions AS (
  SELECT path, session, arg_max(mime_type, seq) AS mime_type, count(*) AS n_chunks,
         string_agg(chunk, '' ORDER BY seq) AS content
  FROM sessions GROUP BY path, session HAVING bool_or(complete)
), assets AS (
  SELECT path, mime_type, n_chunks, content FROM finished_sessions
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY session DESC) = 1)"""

SIZED = ASSETS + """, sized AS (
  SELECT path, mime_type, length(content) AS size FROM assets
), labelled AS (
  SELECT *, CASE
    WHEN size < 1024 THEN size || ' B'
    WHEN size < 1048576 THEN printf('%d.%d KB', floor(size / 1024.0::DOUBLE * 10 + 0.5)::BIGINT // 10,
                                    floor(size / 1024.0::DOUBLE * 10 + 0.5)::BIGINT % 10)
    ELSE printf('%d.%d MB', floor(size / 1048576.0::DOUBLE * 10 + 0.5)::BIGINT // 10,
                floor(size / 1048576.0::DOUBLE * 10 + 0.5)::BIGINT % 10) END AS size_label
  FROM sized)"""

DELETE_PATHS = """delete_paths AS (
  SELECT path FROM docs WHERE doc_id % 9 = 0
  UNION ALL SELECT 'missing/' || doc_id FROM docs WHERE doc_id % 50 = 1 AND doc_id % 9 <> 0)"""

LOOKUP_KEYS = """lookup_keys AS (
  SELECT path FROM docs WHERE doc_id % 7 = 0
  UNION SELECT 'missing/' || doc_id FROM docs WHERE doc_id % 50 = 1 AND doc_id % 7 <> 0)"""

PAYLOADS = """payloads AS (
  SELECT doc_id * 2 + half AS payload_id,
    CASE doc_id % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'live' ELSE 'passport' END AS doc_type,
    CASE WHEN half = 0 THEN text WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN repeat('x', 50)
      WHEN doc_id % 5 = 2 THEN repeat('x', 99) WHEN doc_id % 5 = 3 THEN repeat('x', 100) END AS content
  FROM documents CROSS JOIN (VALUES (0), (1)) AS v(half))"""

NATIONAL_IDS = """plain_ids AS (
  SELECT c_custkey AS k,
    CASE WHEN c_custkey % 97 = 3 THEN '1' WHEN c_custkey % 2 = 0 THEN '2' ELSE '3' END
    || lpad((c_custkey * 7 % 100)::VARCHAR, 2, '0') || lpad((c_custkey % 14)::VARCHAR, 2, '0')
    || lpad((c_custkey % 32)::VARCHAR, 2, '0') || lpad((c_custkey * 3 % 100)::VARCHAR, 2, '0')
    || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || (c_custkey // 10 % 10) || (c_custkey % 10) AS plain
  FROM customer
), national_ids AS (
  SELECT k AS person_id, CASE WHEN k % 50 = 7 THEN plain[1:13]
    WHEN k % 61 = 5 THEN 'X' || plain[2:14] ELSE plain END AS id_number
  FROM plain_ids)"""

DECODED = NATIONAL_IDS + """, parts AS (
  SELECT *, CASE
      WHEN length(id_number) < 14 THEN 'short'
      WHEN try_cast(id_number[1:7] AS INTEGER) IS NULL OR try_cast(id_number[13] AS INTEGER) IS NULL
        THEN 'unparsable'
      WHEN id_number[1] NOT IN ('2', '3') THEN 'bad_century' ELSE 'ok' END AS decode_status
  FROM national_ids
), decoded AS (
  SELECT person_id, id_number, decode_status,
    CASE WHEN decode_status = 'ok' THEN printf('%04d-%02d-%02d',
        (CASE id_number[1] WHEN '2' THEN 1900 ELSE 2000 END) + try_cast(id_number[2:3] AS INTEGER),
        try_cast(id_number[4:5] AS INTEGER), try_cast(id_number[6:7] AS INTEGER))
      ELSE 'Unknown' END AS birth_date,
    CASE WHEN decode_status = 'ok' THEN id_number[8:9] END AS governorate_code,
    CASE WHEN decode_status <> 'ok' THEN 'Unknown'
      WHEN try_cast(id_number[13] AS INTEGER) % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender
  FROM parts)"""

# The governorate codes and names.
GOVERNORATES = """governorates(code, name) AS (VALUES
  ('01', 'Cairo'), ('02', 'Alexandria'), ('03', 'Port Said'), ('04', 'Suez'), ('11', 'Damietta'),
  ('12', 'Dakahlia'), ('13', 'Ash Sharqia'), ('14', 'Kaliobeya'), ('15', 'Kafr El - Sheikh'),
  ('16', 'Gharbia'), ('17', 'Monoufia'), ('18', 'El Beheira'), ('19', 'Ismailia'), ('21', 'Giza'),
  ('22', 'Beni Suef'), ('23', 'Fayoum'), ('24', 'El Menia'), ('25', 'Assiut'), ('26', 'Sohag'),
  ('27', 'Qena'), ('28', 'Aswan'), ('29', 'Luxor'), ('31', 'Red Sea'), ('32', 'New Valley'),
  ('33', 'Matrouh'), ('34', 'North Sinai'), ('35', 'South Sinai'), ('88', 'Foreign'))"""

_CODE3 = "'N' || chr((65 + {k} // 5)::INTEGER) || chr((65 + {k} % 5)::INTEGER)"

COUNTRIES = f"""countries AS (
  SELECT n_nationkey AS list_pos, {_CODE3.format(k='n_nationkey')} AS alpha3,
         'Nation ' || n_nationkey AS name FROM nation WHERE n_nationkey <> 24
  UNION ALL
  SELECT n_nationkey + 1000, {_CODE3.format(k='n_nationkey')}, 'Second entry'
  FROM nation WHERE n_nationkey = 3)"""

MRZ_LINES = f"""mrz_raw AS (
  SELECT k AS passport_id,
    'P<' || code3 || seg || CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN '<<given<<second'
      ELSE '<<given<' || chr((65 + k % 26)::INTEGER) END AS raw1,
    rpad('p' || lpad(k::VARCHAR, 7, '0'), 9, '<') || (k % 10) || code3
      || lpad((k * 3 % 100)::VARCHAR, 2, '0')
      || CASE WHEN k % 11 = 0 THEN '13' WHEN k % 13 = 0 THEN '02'
              ELSE lpad((1 + k % 12)::VARCHAR, 2, '0') END
      || CASE WHEN k % 13 = 0 THEN '30' ELSE lpad((1 + k % 28)::VARCHAR, 2, '0') END
      || (k % 7)
      || CASE k % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '<' WHEN 3 THEN '0' ELSE 'm' END
      || CASE WHEN k % 23 = 0 THEN '<<<<<<' ELSE lpad((20 + k % 15)::VARCHAR, 2, '0')
           || lpad((1 + k % 12)::VARCHAR, 2, '0') || lpad((1 + k % 28)::VARCHAR, 2, '0') END AS raw2
  FROM (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, {_CODE3.format(k='c_nationkey')} AS code3
        FROM customer)
), mrz_lines AS (
  SELECT passport_id, passport_id % 37 <> 0 AS zone_found,
    CASE WHEN passport_id % 37 = 0 THEN NULL WHEN passport_id % 7 = 0 THEN raw1 ELSE rpad(raw1, 44, '<') END AS line1,
    CASE WHEN passport_id % 37 = 0 OR passport_id % 41 = 0 THEN NULL WHEN passport_id % 7 = 0 THEN raw2
         ELSE rpad(raw2, 44, '<') END AS line2
  FROM mrz_raw)"""


def mrz_date(text: str) -> str:
    """DuckDB expression for a six-character date."""
    return (
        f"CASE WHEN regexp_full_match({text}, '[0-9]{{6}}') "
        f"AND try_strptime('20' || {text}, '%Y%m%d') IS NOT NULL "
        f"THEN strftime(try_strptime('20' || {text}, '%Y%m%d'), '%d/%m/%Y') ELSE {text} END"
    )


def _clean(c: str) -> str:
    return f"upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


PASSPORTS = MRZ_LINES + f""", padded AS (
  SELECT passport_id, line2 IS NOT NULL AS ok,
    CASE WHEN length(line1) < 44 THEN rpad(line1, 44, '<') ELSE line1 END AS a,
    CASE WHEN length(line2) < 44 THEN rpad(line2, 44, '<') ELSE line2 END AS b
  FROM mrz_lines
), names AS (
  SELECT *, a[6:44] AS holder, instr(a[6:44], '<<') AS cut FROM padded
), passports AS (
  SELECT passport_id,
    CASE WHEN ok THEN upper(trim(replace(CASE WHEN cut > 0 THEN holder[1:cut - 1] ELSE holder END,
                                         '<', ' '))) END AS surname,
    CASE WHEN ok THEN upper(trim(replace(CASE WHEN cut > 0 THEN substr(holder, cut + 2) ELSE '' END,
                                         '<', ' '))) END AS name,
    CASE WHEN ok THEN CASE WHEN b[21] IN ('M', 'm', '0') THEN 'M' ELSE 'F' END END AS sex,
    CASE WHEN ok THEN {mrz_date('b[14:19]')} END AS date_of_birth,
    CASE WHEN ok THEN {_clean('b[11:13]')} END AS nationality,
    CASE WHEN ok THEN {_clean('a[1:2]')} END AS passport_type,
    CASE WHEN ok THEN {_clean('b[1:9]')} END AS passport_number,
    CASE WHEN ok THEN {_clean('a[3:5]')} END AS issuing_country,
    CASE WHEN ok THEN {mrz_date('b[22:27]')} END AS expiration_date,
    CASE WHEN NOT ok THEN 'Invalid MRZ format: Expected 2 lines' END AS parse_error
  FROM names)"""

NAMED_PASSPORTS = PASSPORTS + ", " + COUNTRIES + """, country_names AS (
  SELECT alpha3, upper(arg_min(name, list_pos)) AS country FROM countries GROUP BY alpha3
), named_passports AS (
  SELECT p.* REPLACE (coalesce(n.country, p.nationality) AS nationality,
                      coalesce(i.country, p.issuing_country) AS issuing_country)
  FROM passports p LEFT JOIN country_names n ON p.nationality = n.alpha3
       LEFT JOIN country_names i ON p.issuing_country = i.alpha3)"""

RECORD_FIELDS = [
    "full_name", "national_id", "birth_date", "address", "governorate",
    "gender", "serial", "first_name", "second_name", "face_image",
]

STRUCTURED = """structured AS (
  SELECT c_custkey AS doc_id,
    CASE WHEN c_custkey % 2 = 0 THEN 'national-id' ELSE 'passport' END AS document_type,
    c_custkey % 3 <> 0 AS has_name, c_custkey % 5 <> 0 AS has_id, c_custkey % 4 <> 1 AS has_number,
    c_custkey % 7 >= 3 AS has_birth, c_custkey % 11 >= 5 AS has_nation, c_custkey % 6 <> 1 AS has_expiry
  FROM customer)"""

DETECTIONS = """detections AS (
  SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS det_seq,
    l_linenumber % 4 * 90 AS angle,
    ['firstName', 'lastName', 'nid', 'address', 'serial', 'photo', 'card'][l_partkey % 7 + 1] AS class_name,
    ((l_partkey * 37 + l_suppkey * 11) % 1000)::DOUBLE / 1000 AS confidence,
    (l_partkey % 600)::INTEGER AS x1, (l_suppkey * 7 % 400)::INTEGER AS y1,
    (l_partkey % 600 + l_quantity * 4 + 1)::INTEGER AS x2,
    (l_suppkey * 7 % 400 + l_quantity * 3 + 1)::INTEGER AS y2,
    800 AS img_width, 600 AS img_height
  FROM lineitem
), det AS (SELECT *, class_name || l_partkey AS text FROM detections)
, images AS (SELECT o_orderkey AS image_id FROM orders)"""

KEPT = DETECTIONS + ", kept AS (SELECT * FROM det WHERE confidence >= 0.3::DOUBLE)"

ANGLES = KEPT + """, angles(angle) AS (VALUES (0), (90), (180), (270)
), scored AS (
  SELECT image_id, angle, count(*) AS n, sum(confidence::DECIMAL(18, 9))::DOUBLE / count(*) AS mean,
    count(*) FILTER (class_name = 'firstName') AS c1, count(*) FILTER (class_name = 'lastName') AS c2,
    count(*) FILTER (class_name = 'nid') AS c3, count(*) FILTER (class_name = 'address') AS c4,
    count(*) FILTER (class_name = 'serial') AS c5
  FROM kept WHERE class_name IN ('firstName', 'lastName', 'nid', 'address', 'serial')
  GROUP BY image_id, angle
), orientation AS (
  SELECT i.image_id, a.angle, coalesce(n, 0) AS field_count, coalesce(mean, 0)::DOUBLE AS avg_conf,
    coalesce(n + mean, 0)::DOUBLE AS score,
    array_to_string(list_filter([CASE WHEN c1 > 0 THEN 'firstName' END, CASE WHEN c2 > 0 THEN 'lastName' END,
      CASE WHEN c3 > 0 THEN 'nid' END, CASE WHEN c4 > 0 THEN 'address' END,
      CASE WHEN c5 > 0 THEN 'serial' END], lambda v: v IS NOT NULL), ',') AS fields,
    coalesce(c1, 0) AS "n_firstName", coalesce(c2, 0) AS "n_lastName", coalesce(c3, 0) AS n_nid,
    coalesce(c4, 0) AS n_address, coalesce(c5, 0) AS n_serial
  FROM images i CROSS JOIN angles a LEFT JOIN scored s ON s.image_id = i.image_id AND s.angle = a.angle
), best AS (
  SELECT image_id, angle, score FROM orientation
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, angle) = 1)"""

PRESENCE = KEPT + """, presence AS (
  SELECT i.image_id,
    coalesce(bool_or(class_name = 'firstName'), false) AS f1,
    coalesce(bool_or(class_name = 'lastName'), false) AS f2,
    coalesce(bool_or(class_name = 'nid'), false) AS f3,
    coalesce(bool_or(class_name = 'address'), false) AS f4,
    coalesce(bool_or(class_name = 'serial'), false) AS f5
  FROM images i LEFT JOIN kept k ON k.image_id = i.image_id GROUP BY i.image_id)"""

DIGITS = """boxed AS (
  SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, i,
    CASE WHEN l_partkey % 7 = 2 THEN l_partkey % 40 + i // 2 * 2 ELSE (l_partkey + i * 131) % 600 // 10 END AS x1,
    CASE WHEN l_partkey % 7 = 2 AND i = 0 THEN 1 + l_suppkey % 3 ELSE (l_partkey + l_suppkey * i) % 10 END AS digit
  FROM lineitem CROSS JOIN range(14) AS v(i) WHERE i < 4 OR l_partkey % 7 = 2
), box_numbers AS (
  SELECT image_id, l_linenumber, l_partkey, l_suppkey, string_agg(digit::VARCHAR, '' ORDER BY x1, i) AS id_number
  FROM boxed GROUP BY image_id, l_linenumber, l_partkey, l_suppkey
), numbers AS (
  SELECT image_id, string_agg(digit::VARCHAR, '' ORDER BY x1, l_linenumber, l_partkey, l_suppkey, i) AS id_number,
         count(*) AS n_digits
  FROM boxed GROUP BY image_id)"""

FRAME_ROWS = """frames AS (
  SELECT event_id AS frame_id, user_id AS session_id, ts, (event_id * 13 % 300)::DOUBLE AS photo_variance,
    event_id % 7 <> 0 AS card_found,
    CASE WHEN event_id % 6 < 3 THEN 'good' WHEN event_id % 6 < 5 THEN 'medium' ELSE 'poor' END AS quality_level,
    event_id % 5 = 4 AS is_blurry, event_id % 8 = 3 AS is_too_dark
  FROM events
)"""

FRAME_RULES = """frame_fields AS (
  SELECT event_id AS frame_id, field, k, ((event_id * 37 + k * 101) % 700 + 300)::DOUBLE / 1000 AS confidence
  FROM events CROSS JOIN (VALUES ('firstName', 1, 2), ('lastName', 2, 7), ('nid', 3, 11),
                                 ('address', 4, 13), ('serial', 5, 9)) AS v(field, k, m)
  WHERE event_id % m <> 1 AND event_id % 23 <> 5
), frame_seen AS (
  SELECT frame_id, count(*) AS n_detections,
    sum(printf('%.3f', confidence)::DECIMAL(18, 3))::DOUBLE / count(*) AS mean_confidence,
    bool_or(k = 1) AS f1, bool_or(k = 2) AS f2, bool_or(k = 3) AS f3, bool_or(k = 4) AS f4, bool_or(k = 5) AS f5
  FROM frame_fields WHERE confidence >= 0.3::DOUBLE GROUP BY frame_id
), facts AS (
  SELECT f.*, coalesce(n_detections, 0) AS n_detections, coalesce(mean_confidence, 0)::DOUBLE AS mean_confidence,
    coalesce(f1, false) AS f1, coalesce(f2, false) AS f2, coalesce(f3, false) AS f3,
    coalesce(f4, false) AS f4, coalesce(f5, false) AS f5,
    CASE WHEN f.frame_id % 3 <> 0 THEN 14 ELSE f.frame_id % 14 END AS n_digits,
    card_found AND photo_variance > 100 AS photo_detected
  FROM frames f LEFT JOIN frame_seen s ON s.frame_id = f.frame_id
), ready AS (
  SELECT *, f2 AND f3 AND f4 AND f5 AS all_required, f1::INT AS optional_found,
    f2::INT + f3::INT + f4::INT + f5::INT AS required_found,
    f1::INT + f2::INT + f3::INT + f4::INT + f5::INT AS fields_found,
    n_detections > 0 AND f2 AND f3 AND f4 AND f5 AND n_digits = 14 AND photo_detected
      AND mean_confidence > 0.4::DOUBLE AND quality_level <> 'poor' AND NOT is_blurry AS ready_for_capture
  FROM facts
), messages AS (
  SELECT *, CASE
    WHEN n_detections = 0 THEN 'No ID card detected. Show your ID to camera.'
    WHEN NOT all_required THEN fields_found || CASE WHEN f1 THEN '/5 fields. Missing: '
           ELSE '/4 required. Missing: ' END
      || array_to_string(list_filter([CASE WHEN NOT f2 THEN 'Last Name' END, CASE WHEN NOT f3 THEN 'National ID' END,
           CASE WHEN NOT f4 THEN 'Address' END, CASE WHEN NOT f5 THEN 'Serial' END],
           lambda v: v IS NOT NULL)[1:3], ', ')
      || CASE WHEN f1 THEN '' ELSE ' (First Name optional)' END
    WHEN n_digits < 14 THEN CASE WHEN f1 THEN 'All 5 fields detected!' ELSE '4/4 required fields.' END
      || ' ID digits: ' || n_digits || '/14. Adjust angle.'
    WHEN NOT photo_detected THEN 'All fields + digits detected. Adjust angle to show photo clearly.'
    WHEN is_blurry THEN 'All required fields detected but image is blurry. Hold steady.'
    WHEN is_too_dark THEN 'All required fields detected but too dark. Find better lighting.'
    WHEN ready_for_capture AND f1 THEN 'Perfect! All 5 fields + photo + 14 digits detected.'
    WHEN ready_for_capture THEN 'Perfect! All required fields + photo + 14 digits. Ready!'
    ELSE 'All required fields detected. Improve image quality.' END AS message
  FROM ready)"""

FRAMES = FRAME_ROWS + ", " + FRAME_RULES

PIXELS = """points AS (
  SELECT vec_id AS image_id, vec_id, embedding, unnest(range(0, len(embedding))) AS p FROM embeddings
), pixels AS (
  SELECT image_id, p % 8 AS x, p // 8 AS y,
    floor(least(greatest(128::DOUBLE + embedding[p + 1]::DOUBLE * 255::DOUBLE
      * ([0, 0.05, 0.06, 0.08, 0.15, 0.35, 1]::DOUBLE[])[vec_id % 7 + 1]
      + ((vec_id % 3 - 1) * 100)::DOUBLE, 0::DOUBLE), 255::DOUBLE))::INTEGER AS g
  FROM points
)"""

IMAGES = PIXELS + """, images AS (
  SELECT *, 8 * sx AS width, 8 * sy AS height, NOT broken AND image_id % 5 <> 0 AS card_found,
    image_id % 3 * sx AS crop_x1, image_id % 2 * sy AS crop_y1, (8 - image_id % 2) * sx AS crop_x2,
    (8 - image_id % 4) * sy AS crop_y2
  FROM (SELECT vec_id AS image_id, vec_id % 31 = 7 AS broken, CASE WHEN vec_id % 25 = 1 THEN 50 ELSE 1 END AS sx,
    CASE WHEN vec_id % 25 = 1 THEN 38 ELSE 1 END AS sy FROM embeddings)
), points_of_images AS (
  SELECT image_id, x * sx + i AS x, y * sy + j AS y, g
  FROM pixels JOIN images USING (image_id), range(sx) AS a(i), range(sy) AS b(j) WHERE NOT broken
), edges AS (
  SELECT image_id, coalesce(lag(g) OVER along, lead(g) OVER along, g) + coalesce(lead(g) OVER along, lag(g) OVER along, g)
    + coalesce(lag(g) OVER down, lead(g) OVER down, g) + coalesce(lead(g) OVER down, lag(g) OVER down, g) - 4 * g AS v
  FROM points_of_images
  WINDOW along AS (PARTITION BY image_id, y ORDER BY x), down AS (PARTITION BY image_id, x ORDER BY y)
), stats AS (
  SELECT image_id, (count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE / (count(*) * count(*)) AS lap
  FROM edges GROUP BY image_id
), greys AS (SELECT image_id, sum(g)::DOUBLE / count(*) AS grey FROM points_of_images GROUP BY image_id
), measures AS (
  SELECT image_id, lap, grey, width, height, least(lap / 100, 1) AS blur, lap < 50 AS is_blurry,
    grey < 50 AS is_too_dark, grey > 200 AS is_too_bright, width >= 400 AND height >= 300 AS size_ok
  FROM images LEFT JOIN stats USING (image_id) LEFT JOIN greys USING (image_id) WHERE NOT broken
), graded AS (
  SELECT *, trunc((blur * 0.5::DOUBLE + (CASE WHEN grey > 50 AND grey < 200 THEN 1 ELSE 0.5 END)::DOUBLE * 0.3::DOUBLE
    + (CASE WHEN size_ok THEN 1 ELSE 0.5 END)::DOUBLE * 0.2::DOUBLE) * 100)::INTEGER AS quality_score FROM measures
), levels AS (
  SELECT *, CASE WHEN quality_score >= 70 AND NOT is_blurry THEN 'good' WHEN quality_score >= 50 THEN 'medium'
    ELSE 'poor' END AS quality_level FROM graded
), rated AS (
  SELECT image_id, quality_score, quality_level, printf('%.2f', blur)::DOUBLE AS blur_score,
    printf('%.2f', grey)::DOUBLE AS brightness, is_blurry, is_too_dark, is_too_bright, size_ok, width, height,
    CASE quality_level WHEN 'good' THEN 'Perfect! Hold steady.'
      WHEN 'medium' THEN CASE WHEN is_blurry THEN 'Image is blurry. Hold steady.'
        WHEN is_too_dark THEN 'Too dark. Find better lighting.'
        WHEN is_too_bright THEN 'Too bright. Reduce glare.' ELSE 'Adjust position for better quality.' END
      ELSE CASE WHEN is_blurry THEN 'Too blurry. Hold camera steady.'
        WHEN is_too_dark THEN 'Too dark. Need more light.'
        WHEN is_too_bright THEN 'Too bright. Move away from light.'
        WHEN NOT size_ok THEN 'Move closer to ID card.' ELSE 'Poor quality. Adjust position.' END END AS feedback
  FROM levels
), photos AS (
  SELECT i.image_id, broken, card_found, v AS variance, card_found AND coalesce(v, 0) > 100 AS detected,
    width AS frame_w, height AS frame_h, crop_x1, crop_y1, crop_x2, crop_y2
  FROM images i LEFT JOIN (
    SELECT image_id, (count(*) * sum(g * g) - sum(g) * sum(g))::DOUBLE / (count(*) * count(*)) AS v
    FROM points_of_images JOIN images USING (image_id)
    WHERE card_found AND y >= crop_y1 AND y < crop_y2 AND x >= crop_x1
      AND x < crop_x1 + trunc((crop_x2 - crop_x1) * 0.3::DOUBLE) GROUP BY image_id) p ON p.image_id = i.image_id
)"""

FACES = """following AS (
  SELECT a.vec_id, a.embedding AS own, coalesce(b.embedding, a.embedding) AS nxt
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
), faces AS (
  SELECT vec_id AS case_id, vec_id % 23 NOT IN (5, 6) AS sent, vec_id % 17 <> 0 AND vec_id % 23 <> 5 AS has_id,
    vec_id % 19 <> 0 AND vec_id % 23 <> 6 AS has_live, own,
    list_transform(list_zip(own, nxt), lambda z: z[1]::DOUBLE * ((vec_id % 11)::DOUBLE / 10)
      + z[2]::DOUBLE * (1::DOUBLE - (vec_id % 11)::DOUBLE / 10)) AS live
  FROM following
), compared AS (
  SELECT case_id, list_cosine_similarity(own::DOUBLE[], live) AS score FROM faces WHERE has_id AND has_live
), verified AS (
  SELECT case_id, round(score, 6) AS similarity_score, NULL::VARCHAR AS error, score > 0.7::DOUBLE AS is_match,
    0.7::DOUBLE AS threshold,
    CASE WHEN score > 0.8::DOUBLE THEN 'high' WHEN score > 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS confidence
  FROM compared)"""

OTP = """otp_events AS (
  SELECT event_id, epoch_us(ts) AS micros, '+20' || lpad(user_id::VARCHAR, 10, '0') AS phone,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'verify' ELSE 'send' END AS action,
    CASE WHEN event_type IN ('purchase', 'error') AND event_id % 4 = 0 THEN '000000'
         ELSE lpad((user_id * 7919 % 1000000)::VARCHAR, 6, '0') END AS code,
    CASE WHEN event_id % 29 = 7 THEN 'HTTP request failed: Timeout' WHEN event_id % 13 = 5 THEN 'Twilio error 400: {}' END AS failed,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
), replay AS (
  SELECT phone, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::BIGINT AS micros,
    NULL::VARCHAR AS held, NULL::BIGINT AS expiry, NULL::BOOLEAN AS success, NULL::VARCHAR AS message
  FROM (SELECT DISTINCT phone FROM otp_events)
  UNION ALL
  SELECT e.phone, e.n, e.event_id, e.action, e.micros,
    CASE WHEN e.action = 'send' THEN CASE WHEN r.held IS NOT NULL AND e.micros < r.expiry THEN r.held ELSE e.code END
         WHEN r.held IS NOT NULL AND e.micros <= r.expiry AND e.code = r.held THEN NULL ELSE r.held END,
    CASE WHEN e.action = 'send' THEN CASE WHEN r.held IS NOT NULL AND e.micros < r.expiry THEN r.expiry
              ELSE e.micros + 14400000000 END
         WHEN r.held IS NOT NULL AND e.micros <= r.expiry AND e.code = r.held THEN NULL ELSE r.expiry END,
    CASE WHEN e.action = 'send' THEN (r.held IS NULL OR e.micros >= r.expiry) AND e.failed IS NULL
         ELSE r.held IS NOT NULL AND e.micros <= r.expiry AND e.code = r.held END,
    CASE WHEN e.action = 'send' THEN CASE WHEN r.held IS NOT NULL AND e.micros < r.expiry
              THEN 'OTP already sent. Please wait ' || ((r.expiry - e.micros) // 1000000) || ' seconds.'
              ELSE coalesce(e.failed, 'OTP sent successfully!') END
         WHEN r.held IS NULL THEN 'No OTP requested for this phone.'
         WHEN e.micros > r.expiry THEN 'OTP expired.'
         WHEN e.code <> r.held THEN 'Invalid OTP.'
         ELSE 'OTP verified successfully!' END
  FROM replay r JOIN otp_events e ON e.phone = r.phone AND e.n = r.n + 1)"""

_ID_DEBUG = (
    '"debug_info":{"debug_image_path":"egyptian_id_debug.jpg","cropped_image_path":"cropped_id_card.jpg",'
    '"yolo_output_path":"d2.jpg","preprocessed_image_path":"preprocessed_image.jpg"}'
)

RESULTS = f"""log_rows AS (
  SELECT c_custkey AS k, 0 AS again, c_custkey % 8 AS shape FROM customer
  UNION ALL SELECT c_custkey, 1, (c_custkey + 3) % 8 FROM customer WHERE c_custkey % 4 = 0
), ocr_results AS (
  SELECT k * 2 + again AS seq, CASE WHEN shape >= 6 THEN 'passport' ELSE 'id' END AS doc_type,
    'uploads/' || k || '.jpg' AS path, k, shape,
    CASE shape
      WHEN 0 THEN '{{"success":true,"processing_time":' || (k % 40) || '.25,"extracted_data":{{"full_name":"Name '
        || k || '","national_id":"2' || lpad(k::VARCHAR, 13, '0') || '"}},{_ID_DEBUG}}}'
      WHEN 1 THEN '{{"success":true,"processing_time":' || (k % 30) || '.5,"extracted_data":{{"full_name":"","national_id":"3'
        || lpad(k::VARCHAR, 13, '0') || '"}},{_ID_DEBUG}}}'
      WHEN 2 THEN '{{"success":true,"processing_time":1.75,"extracted_data":{{"full_name":"Name ' || k || '","national_id":null}}}}'
      WHEN 3 THEN '{{"status":"error","message":"HTTP outcall failed","data":null}}'
      WHEN 4 THEN '{{"error":"failed ' || k || '"}}'
      WHEN 5 THEN '<html>bad gateway ' || k
      WHEN 6 THEN '{{"success":true,"processing_time":2.5,"data":{{"surname":"SUR' || k || '","name":"GIV' || k
        || '","passport_number":"P' || k || '"}},"error":null,"debug_info":{{"mrz_detected":true,"mrz_roi_path":"mrz_roi.jpg","error":null}}}}'
      ELSE '{{"success":false,"processing_time":0.5,"data":null,"error":"no zone ' || k
        || '","debug_info":{{"mrz_detected":false,"mrz_roi_path":null,"error":"No MRZ detected"}}}}' END AS result_json
  FROM log_rows
), latest AS (
  SELECT doc_type, path, seq, result_json FROM ocr_results
  QUALIFY row_number() OVER (PARTITION BY doc_type, path ORDER BY seq DESC) = 1
), result_keys AS (
  SELECT CASE WHEN c_custkey % 12 = 0 THEN 'id' ELSE 'passport' END AS doc_type,
    'uploads/' || c_custkey || '.jpg' AS path
  FROM customer WHERE c_custkey % 6 = 0)"""

RATINGS = """ratings AS (
  SELECT doc_id AS seq, doc_id % 50 AS doc_id, ((doc_id * 3 + doc_id // 50) % 7)::INTEGER AS rating FROM labels
), latest_ratings AS (
  SELECT doc_id, rating FROM ratings QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)"""

STATUS = """status_events AS (
  SELECT o_orderkey AS event_id, o_custkey AS case_id, o_orderdate AS ts,
    CASE WHEN o_orderkey % 101 = 0 THEN 'archived' ELSE ['pending', 'document_uploaded', 'document_verified',
      'otp_verified', 'completed', 'rejected'][o_orderkey % 6 + 1] END AS status
  FROM orders
), current_status AS (
  SELECT case_id, status FROM status_events
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) = 1)"""

# Fields of a case as (key, value) lists in place of maps.
CASES = """scanned AS (
  SELECT c_custkey AS case_id, key, value FROM customer, LATERAL (
    SELECT * FROM (VALUES
      (0, 'full_name', 'Name ' || c_custkey), (0, 'national_id', ''), (0, 'face_image', 'f'),
      (1, 'full_name', ''), (1, 'name', 'Alias ' || c_custkey), (1, 'id', 'I' || c_custkey),
      (2, 'first_name', 'A'), (2, 'second_name', 'B' || c_custkey), (2, 'address', 'Here'),
      (3, 'firstName', 'C' || c_custkey), (3, 'location', ''),
      (4, 'secondName', 'D' || c_custkey), (4, 'birthDate', '1990-01-01')) AS v(kind, key, value)
    WHERE kind = c_custkey % 5)
  WHERE c_custkey % 10 <> 3
), edited AS (
  SELECT c_custkey AS case_id, key, value FROM customer, LATERAL (
    SELECT * FROM (VALUES ('full_name', 'Edited ' || c_custkey), ('address', '')) AS v(key, value))
  WHERE c_custkey % 10 <> 3 AND c_custkey % 6 = 0
), shown AS (
  SELECT * FROM edited UNION ALL
  SELECT * FROM scanned WHERE case_id % 6 <> 0
), review AS (
  SELECT c_custkey AS case_id, 'Phone' AS label,
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '+20' || lpad(c_custkey::VARCHAR, 10, '0') END AS value
  FROM customer WHERE c_custkey % 9 <> 0 OR c_custkey % 10 <> 3 OR c_custkey % 8 <> 0
  UNION ALL
  SELECT c_custkey, 'Document', CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 14 <> 0
    THEN 'scan' || c_custkey || '.jpg' ELSE '—' END
  FROM customer WHERE c_custkey % 9 <> 0 OR c_custkey % 10 <> 3 OR c_custkey % 8 <> 0
  UNION ALL
  SELECT case_id,
    upper(regexp_replace(key, '([A-Z])', ' \\1', 'g')[1]) || regexp_replace(key, '([A-Z])', ' \\1', 'g')[2:] AS label,
    coalesce(nullif(value, ''), '—') AS value
  FROM shown WHERE key <> 'face_image')"""

FILE_SIZES = """file_sizes AS (
  SELECT p_partkey, CASE p_partkey % 100 WHEN 0 THEN 0 WHEN 1 THEN 1023 WHEN 2 THEN 1024 WHEN 3 THEN 1048575
      WHEN 4 THEN 1048576 WHEN 5 THEN 1280 WHEN 6 THEN 1331 ELSE p_partkey * p_partkey * 3 END AS bytes,
    (p_partkey * 37 % 2500 + 50)::INTEGER AS width, (p_partkey * 53 % 2500 + 50)::INTEGER AS height
  FROM part)"""

PATHS = """paths AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' a  b' || replace(url, '://', ' / ')
    WHEN 2 THEN '../' || replace(url, 'http', '') || '/' WHEN 3 THEN 'a//' || page_id || '/-'
    WHEN 4 THEN '-/a...' || page_id || '.png' ELSE 'docs/' || page_id || '_x.png' END AS path
  FROM pages
), clean_paths AS (
  SELECT page_id, path, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
      regexp_replace(trim(path), '\\s+', '-', 'g'), '[^a-zA-Z0-9\\-_./]', '', 'g'), '-+', '-', 'g'), '..', ''),
      '^[-/]+', ''), '/+', '/', 'g'), '[-/]+$', '') AS clean
  FROM paths)"""

PHONES = """phones AS (
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN substr('+20451', 1, (event_id % 24 // 4)::INTEGER)
    ELSE '+20' || lpad(user_id::VARCHAR, 10, '0') END AS phone
  FROM events)"""
