"""The relations: fact table, keys, orders and result columns.

The result column names and their order are fixed values.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from prosopo.plans.fields import Field, flag, gender, long, look, num, real, text


@dataclass(frozen=True)
class Relation:
    table: str
    fields: tuple[Field, ...]
    order: tuple[str, ...]                 # stored columns, NULLs first
    code: str = ""
    label: tuple[str, str, tuple[str, ...]] | None = None   # code table, its key, label choices
    years: tuple[str, str] | None = None   # first and last year columns
    years_replace_person_years: bool = True
    place: str | None = None
    fan_out: tuple[str, tuple[str, ...], str] | None = None  # table, keys, place column
    xy_field: str | None = None
    ties: tuple[str, ...] = field(default=())


PLACES, PERSONS, TEXTS = "ADDR_CODES", "BIOG_MAIN", "TEXT_CODES"


def era(prefix: str, column: str) -> Field:
    return look(prefix, "NIAN_HAO", column, "c_nianhao_id", "c_nianhao_chn", "c_nianhao_pin")


def span(name: str, column: str) -> Field:
    return look(name, "YEAR_RANGE_CODES", column, "c_range_code", "c_range_chn", "c_range")


def cyclic(name: str, column: str) -> Field:
    return look(name, "GANZHI_CODES", column, "c_ganzhi_code", "c_ganzhi_chn", "c_ganzhi_py")


def source(name: str = "source") -> Field:
    return look(name, TEXTS, "c_source", "c_textid", "c_title_chn", "c_title")


def place_pair(native: str, other: str, column: str) -> tuple[Field, Field]:
    return (look(native, PLACES, column, "c_addr_id", "c_name_chn"), look(other, PLACES, column, "c_addr_id", "c_name"))


def person_pair(native: str, other: str, column: str) -> tuple[Field, Field]:
    return (look(native, PERSONS, column, "c_personid", "c_name_chn"), look(other, PERSONS, column, "c_personid", "c_name"))


# columns of the person attached to a fact row carry the prefix b_
WHO = (
    long("person_id", "c_personid"), text("name_chn", "b_c_name_chn"), text("name", "b_c_name"),
    num("index_year", "b_c_index_year"),
    look("index_year_type", "INDEXYEAR_TYPE_CODES", "b_c_index_year_type_code", "c_index_year_type_code",
         "c_index_year_type_hz", "c_index_year_type_desc"),
    gender("sex", "b_c_female"),
    look("dynasty", "DYNASTIES", "b_c_dy", "c_dy", "c_dynasty_chn", "c_dynasty"),
)
WHERE = (
    long("index_address_id", "b_c_index_addr_id"),
    look("index_address", PLACES, "b_c_index_addr_id", "c_addr_id", "c_name_chn", "c_name"),
    look("index_address_type", "BIOG_ADDR_CODES", "b_c_index_addr_type_code", "c_addr_type", "c_addr_desc_chn", "c_addr_desc"),
)

ENTRY = Relation(
    table="ENTRY_DATA", code="c_entry_code", years=("c_year", "c_year"), place="c_entry_addr_id",
    label=("ENTRY_CODES", "c_entry_code", ("c_entry_desc_chn", "c_entry_desc")),
    order=("c_year", "c_personid", "c_sequence"), xy_field="entry_xy_count",
    fields=(
        *WHO, *WHERE,
        num("sequence", "c_sequence", default=0), text("entry_code", "c_entry_code"), text("entry_method", "__label"),
        num("entry_year", "c_year"), era("nianhao", "c_nianhao_id"), num("nianhao_year", "c_entry_nh_year"),
        span("range", "c_entry_range"), text("exam_rank", "c_exam_rank"), num("age", "c_age"),
        look("kinship", "KINSHIP_CODES", "c_kin_code", "c_kincode", "c_kinrel_chn", "c_kinrel"),
        look("kin_person", PERSONS, "c_kin_id", "c_personid", "c_name_chn", "c_name"),
        look("association", "ASSOC_CODES", "c_assoc_code", "c_assoc_code", "c_assoc_desc_chn", "c_assoc_desc"),
        look("associate_person", PERSONS, "c_assoc_id", "c_personid", "c_name_chn", "c_name"),
        look("institution", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_hz", "c_inst_name_py"),
        text("exam_field", "c_exam_field"), long("entry_address_id", "c_entry_addr_id"),
        look("entry_address", PLACES, "c_entry_addr_id", "c_addr_id", "c_name_chn", "c_name"),
        real("entry_x_coord", PLACES, "c_entry_addr_id", "c_addr_id", "x_coord"),
        real("entry_y_coord", PLACES, "c_entry_addr_id", "c_addr_id", "y_coord"),
        long("entry_xy_count", "xy_count", default=0),
        look("parental_status", "PARENTAL_STATUS_CODES", "c_parental_status", "c_parental_status_code",
             "c_parental_status_desc_chn", "c_parental_status_desc"),
        num("attempt_count", "c_attempt_count"), source(), text("pages", "c_pages"), text("notes", "c_notes"),
        text("posting_notes", "c_posting_notes"),
    ))


def _posting_end(which: str, column: str) -> tuple[Field, ...]:
    nh, rng, gz = f"c_{column}_nh_code", f"c_{column}_range", f"c_{column}_day_gz"
    return (
        num(f"{which}_year", f"c_{which}year"), text(f"{which}_nianhao_code", nh),
        look(f"{which}_nianhao", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_chn"),
        look(f"{which}_nianhao_pinyin", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_pin"),
        num(f"{which}_nianhao_year", f"c_{column}_nh_year"), text(f"{which}_range_code", rng),
        look(f"{which}_range_desc", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range"),
        look(f"{which}_range", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range_chn"),
        num(f"{which}_month", f"c_{column}_month"), flag(f"{which}_intercalary", f"c_{column}_intercalary"),
        num(f"{which}_day", f"c_{column}_day"), text(f"{which}_ganzhi_code", gz),
        look(f"{which}_ganzhi", "GANZHI_CODES", gz, "c_ganzhi_code", "c_ganzhi_chn"),
        look(f"{which}_ganzhi_pinyin", "GANZHI_CODES", gz, "c_ganzhi_code", "c_ganzhi_py"),
    )


APPOINTMENT = ("c_appt_code", "c_appt_type_code")   # one column, two names in use

OFFICE = Relation(
    table="POSTED_TO_OFFICE_DATA", code="c_office_id", years=("c_firstyear", "c_lastyear"),
    years_replace_person_years=False, place="c_addr_id",
    label=("OFFICE_CODES", "c_office_id", ("c_office_chn", "c_office_trans", "c_office_pinyin")),
    order=("c_firstyear", "c_personid", "c_posting_id", "c_sequence", "c_addr_id"),
    fan_out=("POSTED_TO_ADDR_DATA", ("c_posting_id", "c_office_id", "c_personid"), "c_addr_id"),
    xy_field="office_xy_count",
    fields=(
        *WHO, look("posting_dynasty", "DYNASTIES", "c_dy", "c_dy", "c_dynasty_chn", "c_dynasty"), *WHERE,
        long("posting_id", "c_posting_id"), num("sequence", "c_sequence", default=0), text("office_code", "c_office_id"),
        text("office", "__label"), text("appointment_code", *APPOINTMENT),
        look("appointment_type", "APPOINTMENT_CODES", APPOINTMENT, "c_appt_code", "c_appt_desc_chn", "c_appt_desc"),
        text("assume_office_code", "c_assume_office_code"),
        look("assume_office", "ASSUME_OFFICE_CODES", "c_assume_office_code", "c_assume_office_code",
             "c_assume_office_desc_chn", "c_assume_office_desc"),
        text("office_category_id", "c_office_category_id"),
        look("category", "OFFICE_CATEGORIES", "c_office_category_id", "c_office_category_id", "c_category_desc_chn", "c_category_desc"),
        *_posting_end("first", "fy"), *_posting_end("last", "ly"),
        text("institution_code", "c_inst_code"), text("institution_name_code", "c_inst_name_code"),
        look("institution", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_hz", "c_inst_name_py"),
        long("office_address_id", "c_addr_id"),
        look("office_address", PLACES, "c_addr_id", "c_addr_id", "c_name_chn", "c_name"),
        real("office_x_coord", PLACES, "c_addr_id", "c_addr_id", "x_coord"),
        real("office_y_coord", PLACES, "c_addr_id", "c_addr_id", "y_coord"),
        long("office_xy_count", "xy_count", default=0),
        long("source_id", "c_source"), source(), text("pages", "c_pages"), text("notes", "c_notes"),
        flag("person_place_match", "__person_place"), flag("office_place_match", "__fact_place"),
        text("place_workflow", "__workflow"), long("office_place_count", "__places", default=0),
    ))


def _status_end(which: str, column: str) -> tuple[Field, ...]:
    nh, rng = f"c_{column}_nh_code", f"c_{column}_range"
    return (
        num(f"{which}_year", f"c_{which}year"), text(f"{which}_nianhao_code", nh),
        look(f"{which}_nianhao", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_chn"),
        look(f"{which}_nianhao_pinyin", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_pin"),
        num(f"{which}_nianhao_year", f"c_{column}_nh_year"), text(f"{which}_range_code", rng),
        look(f"{which}_range_desc", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range"),
        look(f"{which}_range", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range_chn"),
    )


STATUS = Relation(
    table="STATUS_DATA", code="c_status_code",
    label=("STATUS_CODES", "c_status_code", ("c_status_desc_chn", "c_status_desc")),
    order=("c_personid", "c_sequence"), ties=("c_source",),
    fields=(
        *WHO, *WHERE,
        real("x_coord", PLACES, "b_c_index_addr_id", "c_addr_id", "x_coord"),
        real("y_coord", PLACES, "b_c_index_addr_id", "c_addr_id", "y_coord"),
        num("sequence", "c_sequence", default=0), text("status", "__label"), text("status_code", "c_status_code"),
        *_status_end("first", "fy"), *_status_end("last", "ly"),
        text("supplement", "c_supplement"), long("source_id", "c_source"), source(), text("pages", "c_pages"),
        text("notes", "c_notes"),
    ))

ASSOCIATION = Relation(
    table="ASSOC_DATA", code="c_assoc_code", years=("c_assoc_first_year", "c_assoc_first_year"), place="c_addr_id",
    label=("ASSOC_CODES", "c_assoc_code", ("c_assoc_desc_chn", "c_assoc_desc")),
    order=("c_personid", "c_sequence"), ties=("c_assoc_id",),
    fields=(
        *WHO, *WHERE,
        num("sequence", "c_sequence", default=0), text("association_code", "c_assoc_code"), text("association", "__label"),
        long("associate_person_id", "c_assoc_id"), *person_pair("associate_name_chn", "associate_name", "c_assoc_id"),
        num("year", "c_assoc_first_year"), long("address_id", "c_addr_id"), text("text_title", "c_text_title"),
        source(), text("pages", "c_pages"), text("notes", "c_notes"),
    ))

TEXT = Relation(
    table="BIOG_TEXT_DATA", code="c_bibl_cat_code", years=("c_year", "c_year"),
    order=("c_year", "c_personid", "c_textid", "c_role_id"),
    fields=(
        *WHO, long("index_address_id", "b_c_index_addr_id"),
        long("text_id", "c_textid"), text("title", "__title"), text("category_code", "c_bibl_cat_code"),
        text("role", "__role"), num("year", "c_year"), text("pages", "c_pages"), text("notes", "c_notes"),
    ))


def dated(prefix: str, year: str, column: str) -> tuple[Field, ...]:
    """Year, era, era year, month, intercalary, day, cyclic day, range."""
    return (
        num(f"{prefix}year", year), era(f"{prefix}nianhao", f"c_{column}_nh_code"), num(f"{prefix}nianhao_year", f"c_{column}_nh_year"),
        num(f"{prefix}month", f"c_{column}_month"), flag(f"{prefix}intercalary", f"c_{column}_intercalary"),
        num(f"{prefix}day", f"c_{column}_day"), cyclic(f"{prefix}ganzhi", f"c_{column}_day_gz"), span(f"{prefix}range", f"c_{column}_range"),
    )


def dated_short(prefix: str, year: str, column: str) -> tuple[Field, ...]:
    return (num(f"{prefix}year", year), era(f"{prefix}nianhao", f"c_{column}_nh_code"),
            num(f"{prefix}nianhao_year", f"c_{column}_nh_year"), span(f"{prefix}range", f"c_{column}_range"))


TAIL = (source(), text("pages", "c_pages"), text("notes", "c_notes"))

# Person accessors: result columns, then the id columns that make rows addressable.
ACCESSORS: dict[str, Relation] = {
    "addresses": Relation(
        table="BIOG_ADDR_DATA", order=("c_sequence", "c_addr_type", "c_addr_id"),
        fields=(
            num("sequence", "c_sequence", default=0), flag("natal", "c_natal"),
            look("address_type", "BIOG_ADDR_CODES", "c_addr_type", "c_addr_type", "c_addr_desc_chn", "c_addr_desc"),
            *place_pair("address_name_chn", "address_name", "c_addr_id"),
            *dated("first_", "c_firstyear", "fy"), *dated("last_", "c_lastyear", "ly"), *TAIL,
            num("addr_type_code", "c_addr_type"), long("addr_id", "c_addr_id"))),
    "altnames": Relation(
        table="ALTNAME_DATA", order=("c_sequence", "c_alt_name_type_code", "c_alt_name_chn"), ties=("c_source",),
        fields=(
            num("sequence", "c_sequence", default=0), text("alt_name_chn", "c_alt_name_chn"), text("alt_name", "c_alt_name"),
            look("name_type", "ALTNAME_CODES", "c_alt_name_type_code", "c_name_type_code", "c_name_type_desc_chn", "c_name_type_desc"),
            *TAIL, num("name_type_code", "c_alt_name_type_code"), long("source_id", "c_source"))),
    "writings": Relation(
        table="BIOG_TEXT_DATA", order=("c_year", "c_textid", "c_role_id"),
        fields=(
            long("text_id", "c_textid"), look("title_chn", TEXTS, "c_textid", "c_textid", "c_title_chn"),
            look("title", TEXTS, "c_textid", "c_textid", "c_title"),
            look("role", "TEXT_ROLE_CODES", "c_role_id", "c_role_id", "c_role_desc_chn", "c_role_desc"),
            num("year", "c_year"), era("nianhao", "c_nh_code"), num("nianhao_year", "c_nh_year"), span("range", "c_range_code"),
            *TAIL, num("role_id", "c_role_id"))),
    "entries": Relation(
        table="ENTRY_DATA", order=("c_year", "c_sequence", "c_entry_code"),
        fields=(
            num("sequence", "c_sequence", default=0),
            look("entry_method", "ENTRY_CODES", "c_entry_code", "c_entry_code", "c_entry_desc_chn", "c_entry_desc"),
            text("exam_rank", "c_exam_rank"), num("year", "c_year"), era("nianhao", "c_nianhao_id"), num("nianhao_year", "c_entry_nh_year"),
            look("dynasty", "NIAN_HAO", "c_nianhao_id", "c_nianhao_id", "c_dynasty_chn"), span("range", "c_entry_range"), num("age", "c_age"),
            look("kinship", "KINSHIP_CODES", "c_kin_code", "c_kincode", "c_kinrel_chn", "c_kinrel"),
            *person_pair("kin_name_chn", "kin_name", "c_kin_id"),
            look("association", "ASSOC_CODES", "c_assoc_code", "c_assoc_code", "c_assoc_desc_chn", "c_assoc_desc"),
            *person_pair("associate_name_chn", "associate_name", "c_assoc_id"),
            look("institution_name_chn", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_hz"),
            look("institution_name", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_py"),
            *place_pair("entry_address_chn", "entry_address", "c_entry_addr_id"),
            look("parental_status", "PARENTAL_STATUS_CODES", "c_parental_status", "c_parental_status_code",
                 "c_parental_status_desc_chn", "c_parental_status_desc"),
            *TAIL, text("posting_notes", "c_posting_notes"), num("entry_code", "c_entry_code"))),
    "statuses": Relation(
        table="STATUS_DATA", order=("c_sequence", "c_status_code"), ties=("c_source",),
        fields=(
            num("sequence", "c_sequence", default=0),
            look("status", "STATUS_CODES", "c_status_code", "c_status_code", "c_status_desc_chn", "c_status_desc"),
            *dated_short("first_", "c_firstyear", "fy"), *dated_short("last_", "c_lastyear", "ly"), *TAIL,
            num("status_code", "c_status_code"))),
    "possessions": Relation(
        table="POSSESSION_DATA", order=("c_possession_row_id",),
        fields=(
            long("record_id", "c_possession_row_id"), num("sequence", "c_sequence", default=0),
            text("possession", "c_possession_desc_chn", "c_possession_desc"),
            look("possession_action", "POSSESSION_ACT_CODES", "c_possession_act_code", "c_possession_act_code",
                 "c_possession_act_desc_chn", "c_possession_act_desc"),
            text("quantity", "c_quantity"),
            look("measure", "MEASURE_CODES", "c_measure_code", "c_measure_code", "c_measure_desc_chn", "c_measure_desc"),
            num("year", "c_possession_yr"), era("nianhao", "c_possession_nh_code"), num("nianhao_year", "c_possession_nh_yr"),
            span("range", "c_possession_yr_range"), *place_pair("address_name_chn", "address_name", "c_addr_id"), *TAIL)),
    "events": Relation(
        table="EVENTS_DATA", order=("c_year", "c_sequence", "c_event_code"),
        fields=(
            num("sequence", "c_sequence", default=0),
            look("event_name", "EVENT_CODES", "c_event_code", "c_event_code", "c_event_name_chn", "c_event_name"),
            text("role", "c_role"), num("year", "c_year"), era("nianhao", "c_nh_code"), num("nianhao_year", "c_nh_year"),
            num("month", "c_month"), flag("intercalary", "c_intercalary"), num("day", "c_day"), cyclic("ganzhi", "c_day_ganzhi"),
            span("range", "c_yr_range"), *place_pair("address_name_chn", "address_name", "c_addr_id"), source(),
            text("pages", "c_pages"), text("event_text", "c_event"), text("notes", "c_notes"), num("event_code", "c_event_code"))),
    "associations": Relation(
        table="ASSOC_DATA", order=("c_assoc_first_year", "c_sequence", "c_assoc_code", "c_assoc_id"), ties=("c_text_title",),
        fields=(
            num("sequence", "c_sequence", default=0), num("count", "c_assoc_count"), long("associate_person_id", "c_assoc_id"),
            *person_pair("associate_name_chn", "associate_name", "c_assoc_id"),
            look("association", "ASSOC_CODES", "c_assoc_code", "c_assoc_code", "c_assoc_desc_chn", "c_assoc_desc"),
            look("kinship", "KINSHIP_CODES", "c_kin_code", "c_kincode", "c_kinrel_chn", "c_kinrel"),
            long("kin_person_id", "c_kin_id"), *person_pair("kin_name_chn", "kin_name", "c_kin_id"),
            look("associate_kinship", "KINSHIP_CODES", "c_assoc_kin_code", "c_kincode", "c_kinrel_chn", "c_kinrel"),
            long("associate_kin_person_id", "c_assoc_kin_id"),
            *person_pair("associate_kin_name_chn", "associate_kin_name", "c_assoc_kin_id"),
            long("claimer_person_id", "c_assoc_claimer_id"), *person_pair("claimer_name_chn", "claimer_name", "c_assoc_claimer_id"),
            *place_pair("address_name_chn", "address_name", "c_addr_id"),
            num("year", "c_assoc_first_year"), era("nianhao", "c_assoc_fy_nh_code"), num("nianhao_year", "c_assoc_fy_nh_year"),
            num("month", "c_assoc_fy_month"), flag("intercalary", "c_assoc_fy_intercalary"), num("day", "c_assoc_fy_day"),
            cyclic("ganzhi", "c_assoc_fy_day_gz"), span("range", "c_assoc_fy_range"),
            look("topic_chn", "SCHOLARLYTOPIC_CODES", "c_topic_code", "c_topic_code", "c_topic_desc_chn"),
            look("topic", "SCHOLARLYTOPIC_CODES", "c_topic_code", "c_topic_code", "c_topic_desc"),
            look("institution_name_chn", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_hz"),
            look("institution_name", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_py"),
            look("occasion_chn", "OCCASION_CODES", "c_occasion_code", "c_occasion_code", "c_occasion_desc_chn"),
            look("occasion", "OCCASION_CODES", "c_occasion_code", "c_occasion_code", "c_occasion_desc"),
            look("literary_genre_chn", "LITERARYGENRE_CODES", "c_litgenre_code", "c_lit_genre_code", "c_lit_genre_desc_chn"),
            look("literary_genre", "LITERARYGENRE_CODES", "c_litgenre_code", "c_lit_genre_code", "c_lit_genre_desc"),
            text("text_title", "c_text_title"),
            look("source_title_chn", TEXTS, "c_source", "c_textid", "c_title_chn"), look("source_title", TEXTS, "c_source", "c_textid", "c_title"),
            text("pages", "c_pages"), text("notes", "c_notes"), num("assoc_code", "c_assoc_code"))),
    "sources": Relation(
        table="BIOG_SOURCE_DATA", order=("c_textid", "c_pages"),
        fields=(
            look("title_chn", TEXTS, "c_textid", "c_textid", "c_title_chn"), look("title", TEXTS, "c_textid", "c_textid", "c_title"),
            text("pages", "c_pages"), text("notes", "c_notes"), flag("main_source", "c_main_source"), flag("self_bio", "c_self_bio"),
            text("hyperlink", "c_hyperlink"), long("text_id", "c_textid"))),
    "institutions": Relation(
        table="BIOG_INST_DATA", order=("c_bi_begin_year", "c_inst_name_code", "c_inst_code"),
        fields=(
            look("institution_name_chn", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_hz"),
            look("institution_name", "SOCIAL_INSTITUTION_NAME_CODES", "c_inst_name_code", "c_inst_name_code", "c_inst_name_py"),
            look("role", "BIOG_INST_CODES", "c_bi_role_code", "c_bi_role_code", "c_bi_role_chn", "c_bi_role_desc"),
            *dated_short("begin_", "c_bi_begin_year", "bi_by"), *dated_short("end_", "c_bi_end_year", "bi_ey"),
            *place_pair("place_name_chn", "place_name", "c_inst_addr_id"), text("place_type", "c_inst_addr_type"), *TAIL,
            real("x_coord", PLACES, "c_inst_addr_id", "c_addr_id", "x_coord"),
            real("y_coord", PLACES, "c_inst_addr_id", "c_addr_id", "y_coord"),
            long("inst_name_code", "c_inst_name_code"), long("inst_code", "c_inst_code"))),
}


def _flat_posting_end(which: str, column: str) -> tuple[Field, ...]:
    y = "fy" if which == "first" else "ly"
    nh, rng, gz = f"c_{y}_nh_code", f"c_{y}_range", f"c_{y}_day_gz"
    return (
        num(f"{which}_year", f"c_{which}year"),
        look(f"{y}_nianhao_chn", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_chn"),
        look(f"{y}_nianhao_pin", "NIAN_HAO", nh, "c_nianhao_id", "c_nianhao_pin"),
        num(f"{y}_nh_year", f"c_{y}_nh_year"),
        look(f"{y}_range_chn", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range_chn"),
        look(f"{y}_range", "YEAR_RANGE_CODES", rng, "c_range_code", "c_range"),
        num(f"{y}_month", f"c_{y}_month"), flag(f"{y}_intercalary", f"c_{y}_intercalary"), num(f"{y}_day", f"c_{y}_day"),
        look(f"{y}_ganzhi_chn", "GANZHI_CODES", gz, "c_ganzhi_code", "c_ganzhi_chn"),
        look(f"{y}_ganzhi_py", "GANZHI_CODES", gz, "c_ganzhi_code", "c_ganzhi_py"),
    )


POSTING = Relation(
    table="POSTED_TO_OFFICE_DATA", order=("c_posting_id", "c_sequence", "c_office_id", "c_addr_id"),
    fan_out=OFFICE.fan_out,
    fields=(
        long("posting_id", "c_posting_id"), long("office_id", "c_office_id"), num("sequence", "c_sequence", default=0),
        look("office_name_chn", "OFFICE_CODES", "c_office_id", "c_office_id", "c_office_chn"),
        look("office_name", "OFFICE_CODES", "c_office_id", "c_office_id", "c_office_trans"),
        look("appt_desc_chn", "APPOINTMENT_CODES", APPOINTMENT, "c_appt_code", "c_appt_desc_chn"),
        look("appt_desc", "APPOINTMENT_CODES", APPOINTMENT, "c_appt_code", "c_appt_desc"),
        look("assume_office_desc_chn", "ASSUME_OFFICE_CODES", "c_assume_office_code", "c_assume_office_code", "c_assume_office_desc_chn"),
        look("assume_office_desc", "ASSUME_OFFICE_CODES", "c_assume_office_code", "c_assume_office_code", "c_assume_office_desc"),
        look("category_desc_chn", "OFFICE_CATEGORIES", "c_office_category_id", "c_office_category_id", "c_category_desc_chn"),
        look("category_desc", "OFFICE_CATEGORIES", "c_office_category_id", "c_office_category_id", "c_category_desc"),
        *_flat_posting_end("first", "fy"), *_flat_posting_end("last", "ly"),
        look("dynasty_chn", "DYNASTIES", "c_dy", "c_dy", "c_dynasty_chn"), look("dynasty", "DYNASTIES", "c_dy", "c_dy", "c_dynasty"),
        look("source_title_chn", TEXTS, "c_source", "c_textid", "c_title_chn"), look("source_title", TEXTS, "c_source", "c_textid", "c_title"),
        text("pages", "c_pages"), text("notes", "c_notes"),
        text("created_by", "c_created_by"), text("created_date", "c_created_date"),
        text("modified_by", "c_modified_by"), text("modified_date", "c_modified_date"),
        long("addr_id", "c_addr_id"), *place_pair("addr_name_chn", "addr_name", "c_addr_id"),
        text("addr_created_by", "addr_c_created_by"), text("addr_created_date", "addr_c_created_date"),
        text("addr_modified_by", "addr_c_modified_by"), text("addr_modified_date", "addr_c_modified_date"),
    ))

# direct kin; `c_kin_code` and the step vector come from the kinship code table
KIN = (
    long("kin_person_id", "c_kin_id"), text("kinship", "__kinship"), text("kin_name_chn", "k_c_name_chn"), text("kin_name", "k_c_name"),
    flag("is_derived", "__derived"),
    num("up_step", "__up"), num("down_step", "__down"), num("marriage_step", "__mar"), num("collateral_step", "__col"),
    source(), text("pages", "c_pages"), text("notes", "c_notes"), num("kin_code", "c_kin_code"),
)

# kin reached through others; `kinship` is the chain of relations, `notes` its codes
EXPANDED_KIN = (
    long("kin_person_id", "kin_person_id"), text("kinship", "__kinship"), text("kin_name_chn", "k_c_name_chn"), text("kin_name", "k_c_name"),
    flag("is_derived", "is_derived"), num("up_step", "up_step"), num("down_step", "down_step"), num("marriage_step", "marriage_step"),
    num("collateral_step", "collateral_step"), text("source", "__none"), text("pages", "__none"), text("notes", "__notes"),
)

BASIC = (
    long("person_id", "c_personid"), text("name_chn", "c_name_chn"), text("name_rm", "c_name_rm", "c_name"),
    num("index_year", "c_index_year"), look("index_address", PLACES, "c_index_addr_id", "c_addr_id", "c_name_chn", "c_name"),
)

DETAIL = (
    long("person_id", "c_personid"), text("surname_chn", "c_surname_chn"), text("mingzi_chn", "c_mingzi_chn"),
    text("surname", "c_surname"), text("mingzi", "c_mingzi"), text("surname_proper", "c_surname_proper"),
    text("mingzi_proper", "c_mingzi_proper"), text("surname_rm", "c_surname_rm"), text("mingzi_rm", "c_mingzi_rm"),
    text("name", "c_name"), text("name_chn", "c_name_chn"), num("index_year", "c_index_year"),
    look("index_year_type", "INDEXYEAR_TYPE_CODES", "c_index_year_type_code", "c_index_year_type_code",
         "c_index_year_type_hz", "c_index_year_type_desc"),
    text("index_year_source", "c_index_year_source_id"),
    look("dynasty", "DYNASTIES", "c_dy", "c_dy", "c_dynasty"), look("dynasty_chn", "DYNASTIES", "c_dy", "c_dy", "c_dynasty_chn"),
    num("birth_year", "c_birthyear"), num("death_year", "c_deathyear"), gender("gender", "c_female"),
    look("index_address", PLACES, "c_index_addr_id", "c_addr_id", "c_name"),
    look("index_address_chn", PLACES, "c_index_addr_id", "c_addr_id", "c_name_chn"),
    look("index_address_type", "BIOG_ADDR_CODES", "c_index_addr_type_code", "c_addr_type", "c_addr_desc_chn", "c_addr_desc"),
)
