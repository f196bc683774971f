"""Input tables of the operators, derived from the test tables by Spark.

Every derivation is a projection or an explode over one or two tables, so the
inputs grow with the tables. ``Inputs`` reads a folder of Parquet files; each
method returns one input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kredenz.operators.otp import delivery_error

PIXEL_GRID = 8
CHUNK_CHARS = 1000


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- files ------------------------------------------------------------

    def _documents(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id", "text",
            """concat(source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png'
               WHEN 2 THEN '.txt' ELSE '.pdf' END) AS path""",
        )

    @staticmethod
    def _mime(number: str) -> str:
        return (
            f"CASE ({number}) % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' "
            "WHEN 2 THEN 'text/plain' ELSE 'application/pdf' END"
        )

    def files(self) -> DataFrame:
        return self._documents().selectExpr(
            "path", f"{self._mime('doc_id')} AS mime_type", "text AS content"
        )

    def asset_chunks(self) -> DataFrame:
        uploads = self._documents().selectExpr(
            "doc_id", "path", "text",
            "explode(CASE WHEN doc_id % 10 = 0 THEN array(0, 1) ELSE array(0) END) AS upload",
        ).selectExpr(
            "doc_id", "path", "upload",
            "CASE upload WHEN 0 THEN text ELSE concat(text, '#2') END AS content",
            "CASE upload WHEN 0 THEN doc_id % 15 <> 4 ELSE doc_id % 20 <> 10 END AS finished",
        )
        slices = uploads.selectExpr(
            "*", f"explode(sequence(0, (length(content) - 1) div {CHUNK_CHARS})) AS i"
        ).withColumn("last", F.expr(f"i = (length(content) - 1) div {CHUNK_CHARS}"))
        return slices.selectExpr(
            "path",
            f"CASE WHEN last THEN {self._mime('doc_id + upload')} "
            "ELSE 'application/octet-stream' END AS mime_type",
            "doc_id * 1000000 + upload * 500000 + i AS seq",
            f"substring(content, cast(i * {CHUNK_CHARS} + 1 AS INT), {CHUNK_CHARS}) AS chunk",
            "last AND finished AS complete",
        )

    def delete_paths(self) -> DataFrame:
        return self._documents().where("doc_id % 9 = 0 OR doc_id % 50 = 1").selectExpr(
            "CASE WHEN doc_id % 9 = 0 THEN path ELSE concat('missing/', doc_id) END AS path"
        )

    def lookup_keys(self) -> DataFrame:
        return self._documents().where("doc_id % 7 = 0 OR doc_id % 50 = 1").selectExpr(
            "CASE WHEN doc_id % 7 = 0 THEN path ELSE concat('missing/', doc_id) END AS path"
        )

    def payloads(self) -> DataFrame:
        """A request with each whole document, and requests of the boundary sizes beside them."""
        kind = "CASE doc_id % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'live' ELSE 'passport' END AS doc_type"
        documents = self.table("documents")
        whole = documents.selectExpr("doc_id * 2 AS payload_id", kind, "text AS content")
        sizes = documents.selectExpr(
            "doc_id * 2 + 1 AS payload_id", kind,
            """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 50) WHEN 2 THEN repeat('x', 99)
               WHEN 3 THEN repeat('x', 100) END AS content""",
        )
        return whole.unionAll(sizes)

    # -- documents --------------------------------------------------------

    def national_ids(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS person_id",
            """concat(CASE WHEN c_custkey % 97 = 3 THEN '1' WHEN c_custkey % 2 = 0 THEN '2'
                      ELSE '3' END,
                 lpad(c_custkey * 7 % 100, 2, '0'), lpad(c_custkey % 14, 2, '0'),
                 lpad(c_custkey % 32, 2, '0'), lpad(c_custkey * 3 % 100, 2, '0'),
                 lpad(c_custkey % 1000, 3, '0'), c_custkey div 10 % 10, c_custkey % 10) AS plain""",
        ).selectExpr(
            "person_id",
            """CASE WHEN person_id % 50 = 7 THEN substring(plain, 1, 13)
                    WHEN person_id % 61 = 5 THEN concat('X', substring(plain, 2, 13))
                    ELSE plain END AS id_number""",
        )

    @staticmethod
    def _code3(key: str) -> str:
        return f"concat('N', chr(65 + {key} div 5), chr(65 + {key} % 5))"

    def countries(self) -> DataFrame:
        nation = self.table("nation")
        listed = nation.where("n_nationkey <> 24").selectExpr(
            "n_nationkey AS list_pos", f"{self._code3('n_nationkey')} AS alpha3",
            "concat('Nation ', n_nationkey) AS name",
        )
        again = nation.where("n_nationkey = 3").selectExpr(
            "n_nationkey + 1000 AS list_pos", f"{self._code3('n_nationkey')} AS alpha3",
            "'Second entry' AS name",
        )
        return listed.unionByName(again)

    def mrz_lines(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS k", "lower(c_mktsegment) AS seg", f"{self._code3('c_nationkey')} AS code3"
        ).selectExpr(
            "k AS passport_id",
            """concat('P<', code3, seg, CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0
                 THEN '<<given<<second' ELSE concat('<<given<', chr(65 + k % 26)) END) AS raw1""",
            """concat(rpad(concat('p', lpad(k, 7, '0')), 9, '<'), k % 10, code3,
                 lpad(k * 3 % 100, 2, '0'),
                 CASE WHEN k % 11 = 0 THEN '13' WHEN k % 13 = 0 THEN '02'
                      ELSE lpad(1 + k % 12, 2, '0') END,
                 CASE WHEN k % 13 = 0 THEN '30' ELSE lpad(1 + k % 28, 2, '0') END,
                 k % 7, CASE k % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '<'
                             WHEN 3 THEN '0' ELSE 'm' END,
                 CASE WHEN k % 23 = 0 THEN '<<<<<<' ELSE concat(lpad(20 + k % 15, 2, '0'),
                      lpad(1 + k % 12, 2, '0'), lpad(1 + k % 28, 2, '0')) END) AS raw2""",
        ).selectExpr(
            "passport_id", "passport_id % 37 <> 0 AS zone_found",
            """CASE WHEN passport_id % 37 = 0 THEN NULL WHEN passport_id % 7 = 0 THEN raw1
                    ELSE rpad(raw1, 44, '<') END AS line1""",
            """CASE WHEN passport_id % 37 = 0 OR passport_id % 41 = 0 THEN NULL
                    WHEN passport_id % 7 = 0 THEN raw2 ELSE rpad(raw2, 44, '<') END AS line2""",
        )

    def mixed_payloads(self) -> DataFrame:
        """A national ID and a second document of every customer in one table."""
        ids = self.national_ids().selectExpr(
            "person_id * 2 AS payload_id", "'id' AS doc_type", "id_number"
        )
        passports = self.mrz_lines().selectExpr(
            "passport_id * 2 + 1 AS payload_id",
            """CASE WHEN passport_id % 29 = 0 THEN NULL WHEN passport_id % 3 = 0 THEN 'other'
                    ELSE 'passport' END AS doc_type""",
            "line1", "line2",
        )
        return ids.unionByName(passports, allowMissingColumns=True)

    def records(self) -> DataFrame:
        """Scanned ID records in which any field may be missing or empty."""
        def patchy(name: str, i: int) -> str:
            return (
                f"CASE (k + {i}) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' "
                f"ELSE concat('{name}-', k) END AS {name}"
            )

        names = [
            "full_name", "national_id", "birth_date", "address", "governorate",
            "gender", "serial", "first_name", "second_name", "face_image",
        ]
        return self.table("customer").selectExpr("c_custkey AS k").selectExpr(
            "k AS person_id", *[patchy(n, i) for i, n in enumerate(names)]
        )

    def structured_docs(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS k").selectExpr(
            "k AS doc_id",
            "CASE WHEN k % 2 = 0 THEN 'national-id' ELSE 'passport' END AS document_type",
            "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('n', k) END AS name",
            "CASE WHEN k % 5 = 0 THEN '' ELSE concat('i', k) END AS id_number",
            "CASE WHEN k % 4 = 1 THEN NULL ELSE concat('p', k) END AS passport_number",
            "CASE WHEN k % 7 < 3 THEN NULL ELSE '2000-01-01' END AS date_of_birth",
            "CASE WHEN k % 11 < 5 THEN '' ELSE 'N' END AS nationality",
            "CASE WHEN k % 6 = 1 THEN NULL ELSE '2030-01-01' END AS expiry_date",
        )

    # -- detections -------------------------------------------------------

    def images(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS image_id", "800 AS width", "600 AS height"
        )

    def detections(self) -> DataFrame:
        """Boxes from line items; ``det_seq`` is a sortable unique key per image."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS image_id",
            "struct(l_linenumber, l_partkey, l_suppkey) AS det_seq",
            "l_linenumber % 4 * 90 AS angle",
            """CASE l_partkey % 7 WHEN 0 THEN 'firstName' WHEN 1 THEN 'lastName' WHEN 2 THEN 'nid'
                    WHEN 3 THEN 'address' WHEN 4 THEN 'serial' WHEN 5 THEN 'photo'
                    ELSE 'card' END AS class_name""",
            "(l_partkey * 37 + l_suppkey * 11) % 1000 / 1000D AS confidence",
            "cast(l_partkey % 600 AS INT) AS x1",
            "cast(l_suppkey * 7 % 400 AS INT) AS y1",
            "cast(l_partkey % 600 + l_quantity * 4 + 1 AS INT) AS x2",
            "cast(l_suppkey * 7 % 400 + l_quantity * 3 + 1 AS INT) AS y2",
            "800 AS img_width", "600 AS img_height", "l_partkey", "l_suppkey", "l_linenumber",
        ).selectExpr("*", "concat(class_name, l_partkey) AS text")

    def digit_boxes(self) -> DataFrame:
        """Fourteen digits per number box, left to right, and four per other box.

        Several may share a pixel column.
        """
        return self.table("lineitem").selectExpr(
            "l_orderkey AS image_id", "l_linenumber", "l_partkey", "l_suppkey",
            "l_partkey % 7 = 2 AS number",
            "explode(sequence(0, CASE WHEN l_partkey % 7 = 2 THEN 13 ELSE 3 END)) AS i",
        ).selectExpr(
            "image_id", "struct(l_linenumber, l_partkey, l_suppkey, i) AS det_seq",
            "l_linenumber % 4 * 90 AS angle", "struct(l_linenumber, l_partkey, l_suppkey) AS nid_seq",
            """cast(CASE WHEN number AND i = 0 THEN 1 + l_suppkey % 3
                 ELSE (l_partkey + l_suppkey * i) % 10 END AS INT) AS digit""",
            """cast(CASE WHEN number THEN l_partkey % 40 + i div 2 * 2
                 ELSE (l_partkey + i * 131) % 600 div 10 END AS INT) AS x1""",
        )

    # -- frames -----------------------------------------------------------

    def frames(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS frame_id", "user_id AS session_id", "cast(ts AS TIMESTAMP) AS ts",
            "cast(event_id * 13 % 300 AS DOUBLE) AS photo_variance",
            "event_id % 7 <> 0 AS card_found",
            """CASE WHEN event_id % 6 < 3 THEN 'good' WHEN event_id % 6 < 5 THEN 'medium'
                    ELSE 'poor' END AS quality_level""",
            "event_id % 5 = 4 AS is_blurry", "event_id % 8 = 3 AS is_too_dark",
        )

    def frame_fields(self) -> DataFrame:
        rows = """stack(5, 'firstName', 1, 2, 'lastName', 2, 7, 'nid', 3, 11, 'address', 4, 13,
                        'serial', 5, 9) AS (field, k, m)"""
        return self.table("events").selectExpr("event_id AS frame_id", rows).where(
            "frame_id % m <> 1 AND frame_id % 23 <> 5"
        ).selectExpr(
            "frame_id", "field", "((frame_id * 37 + k * 101) % 700 + 300) / 1000D AS confidence"
        )

    def frame_digits(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS frame_id",
            "CASE WHEN event_id % 3 <> 0 THEN 14 ELSE event_id % 14 END AS n",
        ).where("n > 0").selectExpr(
            "frame_id", "explode(sequence(0, cast(n AS INT) - 1)) AS i"
        ).selectExpr(
            "frame_id", "i AS det_seq", "cast((frame_id + i * 3) % 10 AS INT) AS digit",
            "cast((i * 5 + frame_id) % 14 * 20 AS INT) AS x1",
        )

    # -- pixels and faces -------------------------------------------------

    def pixels(self) -> DataFrame:
        contrast = """CASE vec_id % 7 WHEN 0 THEN 0D WHEN 1 THEN 0.05D WHEN 2 THEN 0.06D
                      WHEN 3 THEN 0.08D WHEN 4 THEN 0.15D WHEN 5 THEN 0.35D ELSE 1D END"""
        return self.table("embeddings").selectExpr(
            "vec_id AS image_id", "vec_id", f"{contrast} AS c", "posexplode(embedding) AS (p, e)"
        ).selectExpr(
            "image_id", f"p % {PIXEL_GRID} AS x", f"p div {PIXEL_GRID} AS y",
            """cast(floor(least(greatest(128D + cast(e AS DOUBLE) * 255D * c
                 + cast((vec_id % 3 - 1) * 100 AS DOUBLE), 0D), 255D)) AS INT) AS g""",
            f"{PIXEL_GRID} AS grid_w", f"{PIXEL_GRID} AS grid_h",
        )

    def image_rows(self) -> DataFrame:
        """Image rows from vectors: an 8 x 8 grid of grey cells, some enlarged to 400 x 304.

        Four of five show a card; some files can't be read.
        """
        contrast = """CASE vec_id % 7 WHEN 0 THEN 0D WHEN 1 THEN 0.05D WHEN 2 THEN 0.06D
                      WHEN 3 THEN 0.08D WHEN 4 THEN 0.15D WHEN 5 THEN 0.35D ELSE 1D END"""
        cells = self.table("embeddings").selectExpr(
            "vec_id", "vec_id % 31 = 7 AS broken", "vec_id % 5 <> 0 AS card_found",
            "CASE WHEN vec_id % 25 = 1 THEN 50 ELSE 1 END AS sx", "CASE WHEN vec_id % 25 = 1 THEN 38 ELSE 1 END AS sy",
            f"""transform(embedding, e -> repeat(lpad(hex(cast(floor(least(greatest(128D + cast(e AS DOUBLE) * 255D
                  * {contrast} + cast((vec_id % 3 - 1) * 100 AS DOUBLE), 0D), 255D)) AS INT)), 2, '0'), 3)) AS cell""",
        )
        lines = f"""transform(sequence(0, {PIXEL_GRID - 1}), y -> repeat(array_join(transform(
                      slice(cell, y * {PIXEL_GRID} + 1, {PIXEL_GRID}), c -> repeat(c, sx)), ''), sy))"""

        def known(value: str, name: str, when: str = "NOT broken") -> str:
            return f"CASE WHEN {when} THEN cast({value} AS INT) END AS {name}"

        card = "NOT broken AND card_found"
        return cells.selectExpr(
            "cast(vec_id AS STRING) AS path", known(f"{PIXEL_GRID} * sy", "height"), known(f"{PIXEL_GRID} * sx", "width"),
            known("3", "nChannels"), f"CASE WHEN NOT broken THEN unhex(array_join({lines}, '')) END AS data",
            "CASE WHEN broken THEN 'Could not load image' END AS error",
            known("vec_id % 3 * sx", "crop_x1", card), known("vec_id % 2 * sy", "crop_y1", card),
            known(f"({PIXEL_GRID} - vec_id % 2) * sx", "crop_x2", card), known(f"({PIXEL_GRID} - vec_id % 4) * sy", "crop_y2", card),
        )

    def id_faces(self) -> DataFrame:
        """Face vectors of documents; null where no face was found, no row where no image was sent."""
        return self.table("embeddings").where("vec_id % 23 <> 5").selectExpr(
            "vec_id AS case_id", "CASE WHEN vec_id % 17 <> 0 THEN embedding END AS id_embedding"
        )

    def live_faces(self) -> DataFrame:
        """Each vector blended with its successor's; the last one stays itself."""
        vectors = self.table("embeddings").select("vec_id", "embedding")
        following = vectors.selectExpr("vec_id - 1 AS vec_id", "embedding AS following")
        return vectors.join(following, "vec_id", "left").where("vec_id % 23 <> 6").selectExpr(
            "vec_id AS case_id",
            """CASE WHEN vec_id % 19 <> 0 THEN zip_with(embedding, coalesce(following, embedding),
                 (a, b) -> cast(a AS DOUBLE) * (vec_id % 11 / 10D)
                 + cast(b AS DOUBLE) * (1D - vec_id % 11 / 10D)) END AS live_embedding""",
        )

    # -- one-time codes ---------------------------------------------------

    def otp_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", "cast(ts AS TIMESTAMP) AS ts",
            "concat('+20', lpad(user_id, 10, '0')) AS phone",
            "CASE WHEN event_type IN ('purchase', 'error') THEN 'verify' ELSE 'send' END AS action",
            """CASE WHEN event_type IN ('purchase', 'error') AND event_id % 4 = 0 THEN '000000'
                    ELSE lpad(user_id * 7919 % 1000000, 6, '0') END AS code""",
            "CASE WHEN event_id % 13 <> 5 THEN 200 + event_id % 2 ELSE 400 END AS status",
            "CASE WHEN event_id % 29 = 7 THEN 'Timeout' END AS failure",
        ).withColumn("delivery_error", delivery_error(F.col("status"), F.lit("{}"), F.col("failure")))

    def phones(self) -> DataFrame:
        """Phone texts of every short length as well as full numbers."""
        return self.table("events").selectExpr(
            "event_id",
            """CASE WHEN event_id % 4 = 0 THEN substring('+20451', 1, cast(event_id % 24 div 4 AS INT))
                    ELSE concat('+20', lpad(user_id, 10, '0')) END AS phone""",
        )

    # -- stored results ---------------------------------------------------

    def ocr_results(self) -> DataFrame:
        """Eight JSON shapes; every fourth document is written a second time."""
        rows = self.table("customer").selectExpr(
            "c_custkey AS k", "c_custkey AS c",
            "explode(CASE WHEN c_custkey % 4 = 0 THEN array(0, 1) ELSE array(0) END) AS again",
        ).selectExpr("k", "again", "(k + again * 3) % 8 AS shape")
        id_debug = """'"debug_info":{"debug_image_path":"egyptian_id_debug.jpg","cropped_image_path":"cropped_id_card.jpg","yolo_output_path":"d2.jpg","preprocessed_image_path":"preprocessed_image.jpg"}'"""
        return rows.selectExpr(
            "k * 2 + again AS seq",
            "CASE WHEN shape >= 6 THEN 'passport' ELSE 'id' END AS doc_type",
            "concat('uploads/', k, '.jpg') AS path",
            f"""CASE shape
              WHEN 0 THEN concat('{{"success":true,"processing_time":', k % 40, '.25,"extracted_data":{{"full_name":"Name ', k, '","national_id":"2', lpad(k, 13, '0'), '"}},', {id_debug}, '}}')
              WHEN 1 THEN concat('{{"success":true,"processing_time":', k % 30, '.5,"extracted_data":{{"full_name":"","national_id":"3', lpad(k, 13, '0'), '"}},', {id_debug}, '}}')
              WHEN 2 THEN concat('{{"success":true,"processing_time":1.75,"extracted_data":{{"full_name":"Name ', k, '","national_id":null}}}}')
              WHEN 3 THEN '{{"status":"error","message":"HTTP outcall failed","data":null}}'
              WHEN 4 THEN concat('{{"error":"failed ', k, '"}}')
              WHEN 5 THEN concat('<html>bad gateway ', k)
              WHEN 6 THEN concat('{{"success":true,"processing_time":2.5,"data":{{"surname":"SUR', k, '","name":"GIV', k, '","passport_number":"P', k, '"}},"error":null,"debug_info":{{"mrz_detected":true,"mrz_roi_path":"mrz_roi.jpg","error":null}}}}')
              ELSE concat('{{"success":false,"processing_time":0.5,"data":null,"error":"no zone ', k, '","debug_info":{{"mrz_detected":false,"mrz_roi_path":null,"error":"No MRZ detected"}}}}')
            END AS result_json""",
        )

    def outcalls(self) -> DataFrame:
        """Answers of recognition calls, some failed and some that are no UTF-8."""
        return self.table("customer").selectExpr(
            "CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'passport' END AS doc_type",
            "concat('uploads/', c_custkey div 3, '.jpg') AS path", "c_custkey AS seq",
            """CASE WHEN c_custkey % 13 = 4 THEN unhex('7BC328') WHEN c_custkey % 17 = 2 THEN unhex('')
                    ELSE cast(concat('{"n":', c_custkey, '}') AS BINARY) END AS answer""",
            "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 = 3 END AS failed",
        )

    def result_keys(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 6 = 0").selectExpr(
            "CASE WHEN c_custkey % 12 = 0 THEN 'id' ELSE 'passport' END AS doc_type",
            "concat('uploads/', c_custkey, '.jpg') AS path",
        )

    # -- ratings, statuses, cases -----------------------------------------

    def ratings(self) -> DataFrame:
        return self.table("labels").selectExpr(
            "doc_id AS seq", "doc_id % 50 AS doc_id",
            "cast((doc_id * 3 + doc_id div 50) % 7 AS INT) AS rating",
        )

    def status_events(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS event_id", "o_custkey AS case_id", "cast(o_orderdate AS TIMESTAMP) AS ts",
            """CASE WHEN o_orderkey % 101 = 0 THEN 'archived'
                    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'document_uploaded'
                      WHEN 2 THEN 'document_verified' WHEN 3 THEN 'otp_verified'
                      WHEN 4 THEN 'completed' ELSE 'rejected' END END AS status""",
        )

    def case_phones(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 9 <> 0").selectExpr(
            "c_custkey AS case_id", "concat('+20', lpad(c_custkey, 10, '0')) AS phone"
        )

    def case_docs(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS k").where("k % 10 <> 3").selectExpr(
            "k AS case_id",
            """CASE k % 5
                 WHEN 0 THEN map('full_name', concat('Name ', k), 'national_id', '', 'face_image', 'f')
                 WHEN 1 THEN map('full_name', '', 'name', concat('Alias ', k), 'id', concat('I', k))
                 WHEN 2 THEN map('first_name', 'A', 'second_name', concat('B', k), 'address', 'Here')
                 WHEN 3 THEN map('firstName', concat('C', k), 'location', '')
                 ELSE map('secondName', concat('D', k), 'birthDate', '1990-01-01') END AS ocr_fields""",
            """CASE WHEN k % 6 = 0 THEN map('full_name', concat('Edited ', k), 'address', '') END
               AS edited_fields""",
            "CASE WHEN k % 4 = 0 THEN 'passport' ELSE 'national_id' END AS document_type",
            "CASE WHEN k % 14 <> 0 THEN concat('scan', k, '.jpg') END AS document_name",
        )

    def case_faces(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 8 <> 0").selectExpr(
            "c_custkey AS case_id",
            "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('face', c_custkey) END AS face_image",
            "c_custkey % 3 = 0 AS face_verified", "c_custkey % 5 = 0 AS face_skipped",
        )

    # -- scalar rules -----------------------------------------------------

    def file_sizes(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey",
            """CASE p_partkey % 100 WHEN 0 THEN 0 WHEN 1 THEN 1023 WHEN 2 THEN 1024
                 WHEN 3 THEN 1048575 WHEN 4 THEN 1048576 WHEN 5 THEN 1280 WHEN 6 THEN 1331
                 ELSE p_partkey * p_partkey * 3 END AS bytes""",
            "cast(p_partkey * 37 % 2500 + 50 AS INT) AS width",
            "cast(p_partkey * 53 % 2500 + 50 AS INT) AS height",
        )

    def paths(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "page_id",
            """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat(' a  b', replace(url, '://', ' / '))
                 WHEN 2 THEN concat('../', replace(url, 'http', ''), '/') WHEN 3 THEN concat('a//', page_id, '/-')
                 WHEN 4 THEN concat('-/a...', page_id, '.png') ELSE concat('docs/', page_id, '_x.png') END AS path""",
        )


def image_struct(pixels: DataFrame) -> DataFrame:
    """Pixel rows packed into image rows: grey value in all three channels.

    The pixels of an image become one byte array, as an image file has them.
    """
    row = F.expr("listagg(unhex(lpad(hex(g), 2, '0'))) WITHIN GROUP (ORDER BY struct(y, x))")
    return pixels.groupBy("image_id", "grid_w", "grid_h").agg(row.alias("grey")).select(
        F.col("image_id").cast("string").alias("path"),
        F.col("grid_h").cast("int").alias("height"),
        F.col("grid_w").cast("int").alias("width"),
        F.lit(3).alias("nChannels"),
        F.expr("unhex(regexp_replace(hex(grey), '(..)', '$1$1$1'))").alias("data"),
        F.lit(None).cast("string").alias("error"),
    )
