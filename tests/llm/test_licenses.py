import re

import duckdb

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm.licenses import HINT, KNOWN, OP7_SQL, SENTENCES, op7_licenses, scan_licenses

MIT = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(SENTENCES[k][0].replace(" of this", "\nof this").replace(" NO", "\nNO") for k in ("mit-grant", "mit-notice")) + "\n\n" + " ".join(SENTENCES[k][0] for k in ("mit-as-is", "mit-liability"))
BSD = "\n\n".join([SENTENCES["bsd-grant"][0], "1. " + SENTENCES["bsd-source"][0], "2. " + SENTENCES["bsd-binary"][0]])
BSD2, BSD3 = f"{BSD}\n\n{SENTENCES['bsd-as-is'][0]}", f"{BSD}\n\n3. {SENTENCES['bsd-names'][0]}\n\n{SENTENCES['bsd-as-is'][0]}"
LINES = "junk line\nReleased under the MIT License.\nmore. Licensed under CC BY-NC 4.0. End\n# SPDX-License-Identifier: GPL-3.0-only\nlicensed under the APACHE license, version 2.0"

APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def commented(text, sign):
    return "code = 1\n" + "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n")) + "\nmore = 2"


def test_comments_and_white_space(spark):
    texts = [commented(t, sign) for t in (APACHE, MIT, BSD2, BSD3) for sign in ("#", " *", "//", "--")]
    texts += ["/*\n" + commented(MIT, " *") + "\n*/", SENTENCES["isc-grant"][0].replace(" ", " " * 2_000), "MIT License and more words", "x\nMIT License\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["__vt_licenses"] for r in scan_licenses(docs).orderBy("doc_id").collect()]
    want = [[x] for x in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause") for _ in range(4)]
    assert got == [*want, ["MIT"], ["ISC"], [], ["MIT"]]
    assert all(re.search(HINT, k) for k in KNOWN)


def test_rules(spark):
    docs = odd_documents(spark, [MIT, BSD2, BSD3, LINES, SENTENCES["mpl-2-grant"][0] + " " + SENTENCES["mpl-2-copy"][0], "Released under the MIT Licence of old.", SENTENCES["bsd-source"][0]])
    got = {r["doc_id"]: r["__vt_licenses"] for r in scan_licenses(docs).collect() if r["doc_id"] is not None}
    assert all(got[i] == [] for i in range(10))
    assert [got[10 + i] for i in range(7)] == [["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["MIT", "CC-BY-NC-4.0", "GPL-3.0-only", "Apache-2.0"], ["MPL-2.0"], [], []]


def test_equals_sql(spark, tmp_path):
    path = write_tables(tmp_path / "a", documents=odd_documents(spark, [MIT, BSD2, BSD3, LINES, commented(APACHE, "#"), commented(MIT, " *"), commented(BSD3, "//"), "\n\n MIT License\r\n\r\n"]))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, op7_licenses(spark, path).collect()), key=key) == sorted(db.sql(OP7_SQL).fetchall(), key=key)
    assert op7_licenses(spark, write_tables(tmp_path / "b", documents=odd_documents(spark).limit(0))).count() == 0
