import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.local import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests")
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(scope="session")
def small(spark):
    """A tiny person database with the awkward rows: NULL and empty labels, NULL sequences and years,
    postings with 0, 1 and 3 addresses, orphan and NULL kin, ties, an unknown dynasty, a place cycle."""
    from prosopo import Catalog
    t = spark.createDataFrame
    return Catalog({
        "BIOG_MAIN": t([(1, "Ann", "安", 1000, 15, 10, 1), (2, "Bo", None, 1100, 15, 11, 0), (3, None, "丙", None, 99, 12, None),
                        (4, "Nobody", "無", 1050, 6, None, 0)],
                       "c_personid long, c_name string, c_name_chn string, c_index_year int, c_dy int, c_index_addr_id long, c_female int"),
        "ENTRY_DATA": t([(1, 36, 1010, 1, "a", 10), (1, 36, None, None, "b", 10), (2, 7, 1090, 1, None, 11), (3, 36, 1010, 2, None, None),
                         (9, 36, 1000, 1, None, 10)],
                        "c_personid long, c_entry_code int, c_year int, c_sequence int, c_exam_rank string, c_entry_addr_id long"),
        "ENTRY_CODES": t([(36, "exam", None), (7, "other", "")], "c_entry_code int, c_entry_desc string, c_entry_desc_chn string"),
        "POSTED_TO_OFFICE_DATA": t([(1, 100, 7, 1, 1000, 1005), (1, 101, 7, None, 1010, None), (2, 102, 8, 1, None, None)],
                                   "c_personid long, c_posting_id long, c_office_id long, c_sequence int, c_firstyear int, c_lastyear int"),
        "POSTED_TO_ADDR_DATA": t([(100, 7, 1, 10), (101, 7, 1, 10), (101, 7, 1, 11), (101, 7, 1, 12), (None, 8, 2, 10)],
                                 "c_posting_id long, c_office_id long, c_personid long, c_addr_id long"),
        "OFFICE_CODES": t([(7, None, "Prefect", "zhi"), (8, None, None, "cheng")],
                          "c_office_id long, c_office_chn string, c_office_trans string, c_office_pinyin string"),
        "STATUS_DATA": t([(1, 1, 40, 5), (2, None, 40, 6)], "c_personid long, c_sequence int, c_status_code int, c_source long"),
        "STATUS_CODES": t([(40, "scholar", "士")], "c_status_code int, c_status_desc string, c_status_desc_chn string"),
        "DYNASTIES": t([(15, "Song", "宋", 960, 1279), (6, "Tang", "唐", 618, None)],
                       "c_dy int, c_dynasty string, c_dynasty_chn string, c_start int, c_end int"),
        "KIN_DATA": t([(1, 2, 1), (1, 77, 2), (1, None, 1), (2, 1, 2)], "c_personid long, c_kin_id long, c_kin_code int"),
        "KINSHIP_CODES": t([(1, "F", "父", 1, 0, 0, 0), (2, "S", None, 0, 1, 0, 0)],
                           "c_kincode int, c_kinrel string, c_kinrel_chn string, c_upstep int, c_dwnstep int, c_marstep int, c_colstep int"),
        "ALTNAME_DATA": t([(1, 1, 4, "子瞻", 2), (1, 1, 4, "子瞻", 1), (2, None, 5, "Pole", 3)],
                          "c_personid long, c_sequence int, c_alt_name_type_code int, c_alt_name_chn string, c_source long"),
        "BIOG_ADDR_DATA": t([(1, 1, 1, 10), (1, 2, 1, 11)], "c_personid long, c_sequence int, c_addr_type int, c_addr_id long"),
        "BIOG_TEXT_DATA": t([(1, 1050, 5, 1)], "c_personid long, c_year int, c_textid long, c_role_id int"),
        "ADDR_CODES": t([(10, "Ten", "十", 1.0, 1.0), (11, "Eleven", None, 1.0, 1.0), (12, "Twelve", "十二", None, None)],
                        "c_addr_id long, c_name string, c_name_chn string, x_coord double, y_coord double"),
        # 20 holds 10 and 21, 21 holds 11 and, in a cycle, 20
        "ADDR_BELONGS_DATA": t([(10, 20, None), (21, 20, None), (11, 21, None), (20, 21, None)],
                               "c_addr_id long, c_belongs_to long, c_first_year int"),
    })
