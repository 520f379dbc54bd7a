from tests.test_plans import MODEL, tables  # noqa: F401  a fixture
from tidewell.plans import ingest


def test_a_scanned_file_is_recognised(spark, tables, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    for name in ("scan", "image", "native"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(name.encode())
    said = "La page reconnue du rapport annuel. " * 4

    def pages(content):
        return ["Le rapport annuel. " * 12] if content == b"native" else ["x" if content == b"scan" else ""]

    def split(content):
        assert content != b"native"
        return [content + b"1", content + b"2"]

    def recognise(image):
        return f"{said}{image[-1:].decode()}" if image.startswith(b"scan") else ""

    def save(path, content):
        return ["i.png", "j.png"] if content == b"image" else []

    got = ingest.ingest_folder(spark, str(tmp_path / "in"), tables, MODEL, pdf_reader=pages, page_splitter=split, recogniser=recognise, image_saver=save, min_chars=1)
    assert (got.processed, got.failed) == (3, 0)
    docs = {r["filename"]: r for r in ingest.stored(spark, tables["documents"]).collect()}
    assert {k: r["extraction_method"] for k, r in docs.items()} == {"scan.pdf": "ocr", "image.pdf": "image_extracted", "native.pdf": "native"}
    assert docs["scan.pdf"]["char_count"] == 2 * len(said) + 3
    chunks = ingest.stored(spark, tables["chunks"]).filter("chunk_index = 0").collect()
    assert {c["chunk_metadata"]["source"]: c["chunk_metadata"]["image_paths"] for c in chunks}["image.pdf"] == ["i.png", "j.png"]
