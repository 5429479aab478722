"""Queries over raw detector output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import detections as d
from .catalog import query
from .views import cte, table, view

FRAME = list(d.FRAME)
BOXES = ["x_min", "y_min", "x_max", "y_max"]
F9 = ", ".join(f"round({c}, 9) as {c}" for c in BOXES)


def rounded(df, *cols):
    for c in cols or BOXES:
        df = df.withColumn(c, F.round(c, 9))
    return df


# Raw rows in detector form: line 7 ends the frame, boxes reach past the picture.
_RAW = """select source_id, session_id, frame_index, det_ordinal as row_ordinal,
  case when line = 7 then cast(-1 as double) else cast(0 as double) end as image_id,
  cast((class_id + det_ordinal) % 3 as double) as label, confidence,
  x_min * 1.4 - cast(2 as double) / 10 as x1, y_min * 1.2 - cast(1 as double) / 10 as y1,
  x_max * 1.4 - cast(2 as double) / 10 as x2, y_max * 1.2 - cast(1 as double) / 10 as y2 from v_boxes"""
_RAW = _RAW.replace("1.4", "cast(14 as double) / 10").replace("1.2", "cast(12 as double) / 10")


def raw_rows(spark, sf):
    body = _RAW.split("select ", 1)[1].rsplit(" from ", 1)[0]
    parts, depth, cur = [], 0, ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return view(spark, sf, "v_boxes").selectExpr(*[x.strip() for x in [*parts, cur]])


def _ssd_sql(label: int, cap: int, refuse: bool, category: str, class_id: int) -> str:
    tail = f"where rank <= {cap}" if not refuse else f"where n <= {cap}"
    return cte("v_boxes", f"""
with raw as ({_RAW}),
live as (select *, min(case when image_id < 0 then row_ordinal end) over (partition by source_id, session_id, frame_index)
           as stop_at from raw),
c as (select source_id, session_id, frame_index, confidence,
        least(1, greatest(0, x1)) as x_min, least(1, greatest(0, y1)) as y_min,
        least(1, greatest(0, x2)) as x_max, least(1, greatest(0, y2)) as y_max, row_ordinal
      from live where (stop_at is null or row_ordinal < stop_at) and label = {label} and confidence >= 0.5),
r as (select *, row_number() over (partition by source_id, session_id, frame_index
          order by confidence desc, x_min, y_min, x_max, y_max, row_ordinal) as rank,
        count(*) over (partition by source_id, session_id, frame_index) as n
      from c where x_max > x_min and y_max > y_min)
select source_id, session_id, frame_index, '{category}' as category, cast({class_id} as bigint) as class_id,
  confidence, {F9}, rank from r {tail}""")


def _ssd_out(df):
    return rounded(df.select(*FRAME, "category", "class_id", "confidence", *BOXES, F.col("rank").cast("long")))


@query("ssd_person_top2", _ssd_sql(1, 2, False, "person", 1))
def ssd_person_top2(spark, sf):
    return _ssd_out(d.person_detections(raw_rows(spark, sf), max_people=2).rows)


@query("ssd_plate_top1", _ssd_sql(2, 1, False, "license_plate", 2))
def ssd_plate_top1(spark, sf):
    return _ssd_out(d.plate_detections(raw_rows(spark, sf), max_plates=1).rows)


@query("ssd_vehicle_refuse", _ssd_sql(1, 1, True, "vehicle", 1))
def ssd_vehicle_refuse(spark, sf):
    return _ssd_out(d.vehicle_detections(raw_rows(spark, sf), max_vehicles=1).rows)


@query("ssd_road_vehicle", _ssd_sql(2, 64, True, "vehicle", 2))
def ssd_road_vehicle(spark, sf):
    return _ssd_out(d.vehicle_detections(raw_rows(spark, sf), road_model=True).rows)


@query("ssd_people_count", cte("v_boxes", f"""
with raw as ({_RAW}),
live as (select *, min(case when image_id < 0 then row_ordinal end) over (partition by source_id, session_id, frame_index)
           as stop_at from raw)
select source_id, session_id, frame_index,
  count(case when label = 1 and confidence >= 0.5 and (stop_at is null or row_ordinal < stop_at) then 1 end) as people
from live group by all"""))
def ssd_people_count(spark, sf):
    return d.count_ssd_people(raw_rows(spark, sf), 1)


_CLASS = "[285, 325, 351, 361, 365, 408, 533, 502][cast(det_ordinal % 8 as int) + 1]"
_TENSOR = f"""
with pos as (select *, {_CLASS} as cls,
    row_number() over (partition by source_id, session_id, frame_index order by det_ordinal) - 1 as pos,
    count(*) over (partition by source_id, session_id, frame_index) as cnt from v_boxes),
used as (select * from pos where pos < cnt - frame_index % 2)"""


def tensors(spark, sf):
    """One row per frame with output arrays in row order; odd frames announce one entry less."""
    cls = F.element_at(F.array(*[F.lit(float(c)) for c in (285, 325, 351, 361, 365, 408, 533, 502)]),
                       (F.col("det_ordinal") % 8 + 1).cast("int"))
    e = F.struct("det_ordinal", F.array("y_min", "x_min", "y_max", "x_max").alias("b"), F.col("confidence").alias("s"),
                 cls.alias("c"))
    return view(spark, sf, "v_boxes").groupBy(*FRAME).agg(F.sort_array(F.collect_list(e)).alias("e")).select(
        *FRAME, F.col("e.b").alias("boxes"), F.col("e.s").alias("scores"), F.col("e.c").alias("classes"),
        (F.size("e") - F.col("frame_index") % 2).cast("double").alias("num"))


def _tensor_out(df):
    return rounded(df.select(*FRAME, "category", "class_id", "confidence", *BOXES, F.col("rank").cast("long")))


@query("tensor_security_objects", cte("v_boxes", _TENSOR + f"""
, named as (select *, case cls when 285 then 'knife' when 325 then 'kitchen_knife' when 351 then 'rifle'
    when 361 then 'shotgun' when 365 then 'sword' when 408 then 'weapon' when 533 then 'handgun' end as name from used),
r as (select *, row_number() over (partition by source_id, session_id, frame_index
        order by confidence desc, name, x_min, y_min, x_max, y_max, cls, pos) as rank,
      count(*) over (partition by source_id, session_id, frame_index) as n
      from named where name is not null and confidence >= 0.5)
select source_id, session_id, frame_index, name as category, cast(cls as bigint) as class_id, confidence, {F9}, rank
from r where n <= 3"""))
def tensor_security_objects(spark, sf):
    return _tensor_out(d.tensor_detections(tensors(spark, sf), d.SECURITY_CLASSES, cap=3).rows)


@query("tensor_refused_frames", cte("v_boxes", _TENSOR + """
select source_id, session_id, frame_index, 'too_many_detections' as reason from used
where cls <> 502 and confidence >= 0.5 group by all having count(*) > 3"""))
def tensor_refused_frames(spark, sf):
    return d.tensor_detections(tensors(spark, sf), d.SECURITY_CLASSES, cap=3).refused


@query("tensor_faces", cte("v_boxes", _TENSOR + f"""
, r as (select *, row_number() over (partition by source_id, session_id, frame_index
        order by confidence desc, x_min, y_min, x_max, y_max, pos) as rank
      from used where cls = 502 and confidence >= 0.5)
select source_id, session_id, frame_index, 'face' as category, cast(502 as bigint) as class_id, confidence, {F9}, rank
from r"""))
def tensor_faces(spark, sf):
    return _tensor_out(d.tensor_detections(tensors(spark, sf), d.FACE_CLASSES).rows)


@query("landmark_faces", cte("v_boxes", f"""
with r as (select *, row_number() over (partition by source_id, session_id, frame_index
        order by confidence desc, x_min, y_min, x_max, y_max, det_ordinal) as rank from v_boxes where confidence >= 0.85)
select source_id, session_id, frame_index, 'face' as category, confidence, {F9}, rank from r"""))
def landmark_faces(spark, sf):
    zero = [F.lit(0.0)] * 10
    raw = view(spark, sf, "v_boxes").select(
        *FRAME, F.col("det_ordinal").alias("row_ordinal"), F.lit(1000).alias("width"), F.lit(1000).alias("height"),
        F.array(F.col("x_min") * 1000, F.col("y_min") * 1000, (F.col("x_max") - F.col("x_min")) * 1000,
                (F.col("y_max") - F.col("y_min")) * 1000, *zero, F.col("confidence")).alias("vals"))
    out = d.landmark_face_detections(raw, threshold=0.85).rows
    return rounded(out.select(*FRAME, "category", "confidence", *BOXES, F.col("rank").cast("long")))


_RECTS = """
with rects as (select source_id, session_id, frame_index, det_ordinal,
    cast(l_x as bigint) as x, cast(l_y as bigint) as y, w as width, h as height,
    cast(w * h * (20 + det_ordinal % 80) as double) / 100 as contour_area,
    cast(1000 as bigint) as image_width, cast(600 as bigint) as image_height
  from (select *, floor(x_min * 1000) as l_x, floor(y_min * 600) as l_y,
          60 + (det_ordinal % 7) * 20 as w, 20 + (det_ordinal % 5) * 6 as h from v_boxes)),
p as (select *, cast(width as double) / height as aspect, cast(width as double) / image_width as wf,
    cast(height as double) / image_height as hf, cast(width * height as double) / (image_width * image_height) as af,
    least(1, contour_area / (width * height)) as rect from rects
  where x >= 0 and y >= 0 and x + width <= image_width and y + height <= image_height),
q as (select *, least(1, greatest(0, cast(0.45 as double) * greatest(0, 1 - abs(aspect - cast(4.2 as double))
        / greatest(cast(4.2 as double) - 2, cast(6.5 as double) - cast(4.2 as double)))
      + cast(0.35 as double) * least(1, rect / cast(0.8 as double))
      + cast(0.2 as double) * least(1, wf / cast(0.2 as double)))) as score,
    cast(x as double) / image_width as x_min, cast(y as double) / image_height as y_min,
    cast(x + width as double) / image_width as x_max, cast(y + height as double) / image_height as y_max
  from p where aspect between 2 and cast(6.5 as double) and wf between cast(0.03 as double) and cast(0.8 as double)
    and hf between cast(0.01 as double) and cast(0.25 as double) and af between cast(0.0003 as double)
    and cast(0.2 as double) and rect >= cast(0.2 as double))"""


def rectangles(spark, sf):
    o = "det_ordinal"
    return view(spark, sf, "v_boxes").selectExpr(
        *FRAME, o, "cast(floor(x_min * 1000) as bigint) x", "cast(floor(y_min * 600) as bigint) y",
        f"60 + ({o} % 7) * 20 width", f"20 + ({o} % 5) * 6 height",
        f"cast((60 + ({o} % 7) * 20) * (20 + ({o} % 5) * 6) * (20 + {o} % 80) as double) / 100 contour_area",
        "cast(1000 as bigint) image_width", "cast(600 as bigint) image_height")


@query("plate_proposals", cte("v_boxes", _RECTS + f"""
select source_id, session_id, frame_index, det_ordinal, round(score, 9) as score, {F9} from q"""))
def plate_proposals(spark, sf):
    out = d.plate_proposals(rectangles(spark, sf))
    return rounded(out.select(*FRAME, "det_ordinal", "score", *BOXES), "score", *BOXES)


@query("plate_proposals_nms", cte("v_boxes", _RECTS + """,
o as (select *, row_number() over (partition by source_id, session_id, frame_index
        order by score desc, x_min, y_min, x_max, y_max) as rn from q),
walk as (
  select source_id, session_id, frame_index, rn,
    [{'s': score, 'a': x_min, 'b': y_min, 'c': x_max, 'd': y_max}] as kept from o where rn = 1
  union all
  select o.source_id, o.session_id, o.frame_index, o.rn,
    case when len(list_filter(w.kept, lambda k: greatest(0, least(k.c, o.x_max) - greatest(k.a, o.x_min))
          * greatest(0, least(k.d, o.y_max) - greatest(k.b, o.y_min)) / ((k.c - k.a) * (k.d - k.b)
          + (o.x_max - o.x_min) * (o.y_max - o.y_min) - greatest(0, least(k.c, o.x_max) - greatest(k.a, o.x_min))
          * greatest(0, least(k.d, o.y_max) - greatest(k.b, o.y_min))) > 0.5)) > 0 or len(w.kept) >= 16
      then w.kept else list_append(w.kept, {'s': o.score, 'a': o.x_min, 'b': o.y_min, 'c': o.x_max, 'd': o.y_max}) end
  from walk w join o on w.source_id = o.source_id and w.session_id = o.session_id
    and w.frame_index = o.frame_index and o.rn = w.rn + 1),
fin as (select * from walk qualify row_number() over (partition by source_id, session_id, frame_index
          order by rn desc) = 1),
u as (select source_id, session_id, frame_index, unnest(kept) as k, generate_subscripts(kept, 1) as rank from fin)
select source_id, session_id, frame_index, rank, round(k.s, 9) as score, round(k.a, 9) as x_min,
  round(k.b, 9) as y_min, round(k.c, 9) as x_max, round(k.d, 9) as y_max from u"""))
def plate_proposals_nms(spark, sf):
    return rounded(d.suppress_overlaps(d.plate_proposals(rectangles(spark, sf))), "score", *BOXES)


_WORDS = """
with w as (select p_partkey as crop_id, unnest(string_split(p_name, ' ')) as text,
    generate_subscripts(string_split(p_name, ' '), 1) as pos, p_size from part),
words as (select crop_id, pos, cast((p_size * 2 + pos * 7) % 130 - 10 as varchar) as conf,
    case when (crop_id + pos) % 9 = 0 then text || '#' else text end as text from w)"""


def words(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey crop_id", "p_size", "posexplode(split(p_name, ' ')) as (pos, text)").selectExpr(
        "crop_id", "pos + 1 word_ordinal", "'5' level", "cast((p_size * 2 + (pos + 1) * 7) % 130 - 10 as string) conf",
        "case when (crop_id + pos + 1) % 9 = 0 then concat(text, '#') else text end text")


@query("plate_reads", _WORDS + """,
ok as (select crop_id, bool_and(text not like '%#%' and cast(conf as double) between 20 and 100) as good,
    min(cast(conf as double) / 100) as c, string_agg(upper(text), '' order by pos) as t from words group by crop_id)
select crop_id, case when good and len(t) between 1 and 16 then t end as plate_text,
  case when good and len(t) between 1 and 16 then round(c, 9) end as confidence from ok""")
def plate_reads(spark, sf):
    return rounded(d.plate_reads(words(spark, sf), min_confidence=0.2), "confidence")


@query("plate_read_composition", _WORDS + """,
ok as (select crop_id, bool_and(text not like '%#%' and cast(conf as double) between 20 and 100) as good,
    string_agg(upper(text), '' order by pos) as t from words group by crop_id)
select o.crop_id, t as plate_text, cast(50 + o.crop_id % 50 as double) / 100 as confidence from ok o
where good and len(t) between 1 and 16""")
def plate_read_composition(spark, sf):
    plates = table(spark, sf, "part").selectExpr("p_partkey crop_id", "cast(50 + p_partkey % 50 as double) / 100 confidence")
    return d.read_plates(plates, d.plate_reads(words(spark, sf), 0.2)).rows.select("crop_id", "plate_text", "confidence")


@query("plate_read_abstentions", _WORDS + """
select crop_id, 'abstained' as reason from words group by crop_id
having not (bool_and(text not like '%#%' and cast(conf as double) between 20 and 100)
            and len(string_agg(upper(text), '')) between 1 and 16)""")
def plate_read_abstentions(spark, sf):
    plates = table(spark, sf, "part").selectExpr("p_partkey crop_id")
    return d.read_plates(plates, d.plate_reads(words(spark, sf), 0.2)).refused


_SLOT = "case when i >= 6 + pk % 5 or (pk % 11 = 0 and i = 2) then 36 else (pk * 7 + i * 5) % 36 end"


@query("slot_plate_decode", f"""
with s as (select p_partkey as pk, i, {_SLOT} as slot, cast(84 + (p_partkey + i) % 16 as double) / 100 as best
           from (select p_partkey, p_partkey as pk, unnest(range(10)) as i from part)),
r as (select pk, string_agg(substr('{t.SLOT_ALPHABET}', cast(slot as int) + 1, 1), '' order by i) as raw_text,
        min(best) as c from s group by pk)
select pk as crop_id, raw_text, round(c, 9) as confidence,
  case when c < 0.85 then 'low_confidence' when rtrim(raw_text, '_') = '' then 'blank'
       when contains(rtrim(raw_text, '_'), '_') then 'interior_padding' end as rejection_reason,
  case when c >= 0.85 and rtrim(raw_text, '_') <> '' and not contains(rtrim(raw_text, '_'), '_')
       then rtrim(raw_text, '_') end as plate_text from r""")
def slot_plate_decode(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey crop_id", f"""
        transform(transform(sequence(0, 9), i -> struct(i as i, {_SLOT.replace('pk', 'p_partkey')} as slot,
            cast(84 + (p_partkey + i) % 16 as double) / 100 as best)),
          s -> transform(sequence(0, 36), j -> case when j = s.slot then s.best else (1 - s.best) / 36 end)) slots""")
    out = t.decode_slots(F.col("slots"), 0.85)
    return rounded(df.select("crop_id", *[c.alias(n) for n, c in out.items()]), "confidence")


@query("plate_text_normalise", """
with n as (select c_custkey as id, c_name as raw from customer union all select -1 - s_suppkey, s_name from supplier
           union all select 1000000000 + p_partkey, p_name from part union all
           select 2000000000 + o_orderkey, o_orderpriority from orders)
select id, raw, case when regexp_full_match(raw, '[A-Za-z0-9 -]*') and len(upper(translate(raw, ' -', ''))) <= 16
  then upper(translate(raw, ' -', '')) end as plate_text from n""")
def plate_text_normalise(spark, sf):
    def names(tbl, key, col):
        return table(spark, sf, tbl).selectExpr(f"{key} id", f"{col} raw")

    n = names("customer", "c_custkey", "c_name").unionAll(names("supplier", "-1 - s_suppkey", "s_name")).unionAll(
        names("part", "1000000000 + p_partkey", "p_name")).unionAll(
        names("orders", "2000000000 + o_orderkey", "o_orderpriority"))
    return n.withColumn("plate_text", t.plate_text(F.col("raw")))


@query("attribute_text_normalise", r"""
select page_id, x as raw, case when regexp_full_match(x2, '[A-Za-z0-9_.:/ -]{1,128}') then x2 end as attribute_text
from (select page_id, concat('  ', url, '   v1 ') as x,
        trim(regexp_replace(concat('  ', url, '   v1 '), '\s+', ' ', 'g')) as x2 from pages)""")
def attribute_text_normalise(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "concat('  ', url, '   v1 ') raw").withColumn(
        "attribute_text", t.attribute_text(F.col("raw")))


# Box arithmetic -----------------------------------------------------------------------------------------------------
_IOU = """case when least(a.x_max, b.x_max) <= greatest(a.x_min, b.x_min) or least(a.y_max, b.y_max) <=
  greatest(a.y_min, b.y_min) then cast(0 as double) else
  (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min))
  / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min)
  - (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min))) end"""


@query("box_iou_pairs", cte("v_boxes", f"""
select a.frame_index, a.det_ordinal as a_ordinal, b.det_ordinal as b_ordinal, round({_IOU}, 9) as iou,
  round({_IOU}, 9) as iou_scaled
from v_boxes a join v_boxes b on a.frame_index = b.frame_index and a.category = b.category
  and a.det_ordinal < b.det_ordinal"""))
def box_iou_pairs(spark, sf):
    v = view(spark, sf, "v_boxes").select("frame_index", "category", "det_ordinal", *BOXES)
    b = v.select("frame_index", "category", F.col("det_ordinal").alias("b_ordinal"),
                 *[F.col(c).alias("b_" + c) for c in BOXES])
    j = v.withColumnRenamed("det_ordinal", "a_ordinal").join(b, ["frame_index", "category"]).filter(
        "a_ordinal < b_ordinal")
    return j.select("frame_index", "a_ordinal", "b_ordinal",
                    F.round(g.iou(g.box(), g.box("b_")), 9).alias("iou"),
                    F.round(g.iou_scaled(g.box(), g.box("b_")), 9).alias("iou_scaled"))


@query("box_geometry", cte("v_boxes", """
select frame_index, det_ordinal,
  cast(greatest(0, least(1919, floor(x_min * 1920))) as bigint) as crop_left,
  cast(greatest(0, least(1079, floor(y_min * 1080))) as bigint) as crop_top,
  cast(greatest(greatest(0, least(1919, floor(x_min * 1920))) + 1, least(1920, ceil(x_max * 1920))) as bigint) as crop_right,
  cast(greatest(greatest(0, least(1079, floor(y_min * 1080))) + 1, least(1080, ceil(y_max * 1080))) as bigint) as crop_bottom,
  round(case when x_min = round_even(x_min * 800, 0) / 800 then round_even(x_min * 800, 0) else x_min * 800 end, 9) as snapped,
  round(case when line % 2 = 0 then 1 - y_max else y_min end, 9) as turned_x_min,
  round(case when line % 2 = 0 then x_min else 1 - x_max end, 9) as turned_y_min,
  round(case when line % 2 = 0 then 1 - y_min else y_max end, 9) as turned_x_max,
  round(case when line % 2 = 0 then x_max else 1 - x_min end, 9) as turned_y_max,
  round((x_max - x_min) * (y_max - y_min), 9) as full_frame_iou from v_boxes"""))
def box_geometry(spark, sf):
    v = view(spark, sf, "v_boxes")
    w, h = F.lit(1920), F.lit(1080)
    crop = g.crop_bounds(g.to_pixels(g.box(), w, h), w, h)
    turned = g.unrotate(g.box(), F.when(F.col("line") % 2 == 0, 1).otherwise(-1))
    return v.select(
        "frame_index", "det_ordinal",
        *[c.alias("crop_" + n) for c, n in zip(crop, ("left", "top", "right", "bottom"))],
        F.round(g.snap_to_pixel(F.col("x_min"), F.lit(800)), 9).alias("snapped"),
        *[F.round(c, 9).alias("turned_" + n) for c, n in zip(turned, BOXES)],
        F.round(g.full_frame_iou(g.box()), 9).alias("full_frame_iou"))


_SIG = "greatest(5, least(r - l, b - t) * cast(0.16 as double))"


@query("redaction_plan", cte("v_boxes", f"""
with p as (select frame_index, det_ordinal, x_min * 3840 as x1, y_min * 2160 as y1, x_max * 3840 as x2, y_max * 2160 as y2 from v_boxes),
e as (select frame_index, det_ordinal, greatest(0, least(3839, floor(x1 - (x2 - x1) * cast(0.12 as double)))) as l,
    greatest(0, least(2159, floor(y1 - (y2 - y1) * cast(0.12 as double)))) as t,
    ceil(x2 + (x2 - x1) * cast(0.12 as double)) as rr, ceil(y2 + (y2 - y1) * cast(0.12 as double)) as bb from p),
c as (select *, greatest(l + 1, least(3840, rr)) as r, greatest(t + 1, least(2160, bb)) as b from e),
s as (select *, {_SIG} as sigma, greatest(1, floor((r - l) * (32 / ({_SIG})))) as tw,
        greatest(1, floor((b - t) * (32 / ({_SIG})))) as th from c)
select frame_index, det_ordinal, cast(l as bigint) as left_px, cast(t as bigint) as top_px, cast(r as bigint) as right_px,
  cast(b as bigint) as bottom_px, cast(case when sigma <= 32 then r - l else tw end as bigint) as blur_width,
  cast(case when sigma <= 32 then b - t else th end as bigint) as blur_height,
  round(case when sigma <= 32 then sigma else sigma * (tw / (r - l)) end, 9) as sigma_x,
  round(case when sigma <= 32 then sigma else sigma * (th / (b - t)) end, 9) as sigma_y from s"""))
def redaction_plan(spark, sf):
    from ..operators.privacy import redaction_plan as plan

    v = view(spark, sf, "v_boxes").withColumns({"width": F.lit(3840), "height": F.lit(2160)})
    return rounded(plan(v).select("frame_index", "det_ordinal", "left_px", "top_px", "right_px", "bottom_px",
                                  "blur_width", "blur_height", "sigma_x", "sigma_y"), "sigma_x", "sigma_y")


@query("privacy_actions", cte("v_boxes", """
with f as (select frame_index, count(*) as face_count from v_boxes group by 1)
select frame_index, face_count, case when frame_index % 3 = 0 and frame_index % 2 = 0 then 'unblur'
   when frame_index % 3 = 0 then 'unblur_denied' else 'blur' end as action from f where face_count <= 6"""))
def privacy_actions(spark, sf):
    from ..operators.privacy import privacy_actions as act

    v = view(spark, sf, "v_boxes")
    frames = v.select("frame_index").distinct().withColumns({
        "request_unblur": F.col("frame_index") % 3 == 0, "authorized_unblur": F.col("frame_index") % 2 == 0})
    return act(frames, v, frame=("frame_index",), max_faces=6).rows.select("frame_index", "face_count", "action")


_PERIOD = 7_200_000


@query("sampled_frames", cte("v_event_records", f"""
with s as (select source_id, observation_id, timestamp_ms, row_number() over (partition by source_id
             order by timestamp_ms, observation_id) as rn from v_event_records),
walk as (select source_id, rn, observation_id, timestamp_ms, timestamp_ms + {_PERIOD} as nxt, true as hit from s where rn = 1
  union all
  select s.source_id, s.rn, s.observation_id, s.timestamp_ms,
    case when s.timestamp_ms >= w.nxt then s.timestamp_ms + {_PERIOD} else w.nxt end, s.timestamp_ms >= w.nxt
  from walk w join s on s.source_id = w.source_id and s.rn = w.rn + 1)
select source_id, observation_id as frame_id, timestamp_ms from walk where hit"""))
def sampled_frames(spark, sf):
    v = view(spark, sf, "v_event_records").withColumnRenamed("observation_id", "frame_id")
    return d.sampled_frames(v, _PERIOD, ["source_id"], bucket_ms=24 * 3_600_000)
