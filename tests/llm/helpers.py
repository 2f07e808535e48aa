"""Small helpers of the tests of this folder."""


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
