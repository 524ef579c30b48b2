"""SQL statements with the same results as the registered queries.

They are written independently of the Spark code: plain windows, string aggregation and
recursive queries over the whole derived snapshots, fit for checking, not for size. Common
table expressions are listed once and pulled in by name.
"""

from __future__ import annotations

import re

from braidset import schema
from braidset.catalog import derive
from braidset.functions.hashing import FNV_PRIME, GUID_SEEDS
from braidset.functions.text import HIGHLIGHT_COLORS
from braidset.plans.cleanup import CLEANED_TABLE
from braidset.plans.health import CHECKS

_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SEP = "chr(31)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    x = f"coalesce({x}, '')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\x{{00A0}}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    return trim(x)


def millis(x: str) -> str:
    return f"epoch_ms(CAST({x} AS TIMESTAMPTZ))"


def ord_(pk: str, src: str = "src") -> str:
    """Encounter order as one number."""
    return f"({src} * 10000000000000000 + {pk})"


def fnv(x: str, seed: int) -> str:
    return (
        f"list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
        f"lambda h, c: (xor(h, c) * {FNV_PRIME}) & 4294967295, CAST({seed} AS BIGINT))"
    )


def guid(x: str) -> str:
    w = [f"lpad(lower(to_hex({fnv(x, s)})), 8, '0')" for s in GUID_SEEDS]
    variant = f"lower(to_hex((CAST('0x' || substr({w[2]}, 1, 1) AS INT) & 3) | 8))"
    return (
        f"({w[0]} || '-' || substr({w[1]}, 1, 4) || '-4' || substr({w[1]}, 6, 3) || '-' || {variant} || substr({w[2]}, 2, 3) "
        f"|| '-' || substr({w[2]}, 5, 4) || {w[3]})"
    )


def ext(x: str) -> str:
    return f"regexp_extract({x}, '(?s)^.+(\\.[^.]*)$', 1)"


def describe(p: str = "") -> str:
    title = f"nullif({trim(f'coalesce({p}Title, chr(32))')}, '')"
    sym = f"nullif({p}KeySymbol, '')"
    book = (
        f"CASE WHEN coalesce({p}BookNumber, 0) <> 0 THEN 'book ' || {p}BookNumber || "
        f"CASE WHEN coalesce({p}ChapterNumber, 0) <> 0 THEN ' ch. ' || {p}ChapterNumber ELSE '' END END"
    )
    return (
        f"coalesce(nullif(concat_ws(' · ', coalesce({title}, {sym}), {book}, "
        f"CASE WHEN coalesce({p}DocumentId, 0) <> 0 THEN 'doc ' || {p}DocumentId END, 'track ' || {p}Track, "
        f"CASE WHEN coalesce({p}IssueTagNumber, 0) <> 0 THEN 'issue ' || {p}IssueTagNumber END, "
        f"CASE WHEN {title} IS NOT NULL AND {sym} IS NOT NULL THEN '(' || {sym} || ')' END), ''), 'location #' || {p}LocationId)"
    )


_LOC = ["BookNumber", "ChapterNumber", "DocumentId", "Track", "IssueTagNumber", "KeySymbol", "MepsLanguage", "Type", "Specialty", "Edition"]
_F = ", ".join(["BookNumber", "ChapterNumber", "DocumentId", "Track", "IssueTagNumber", "KeySymbol", "MepsLanguage", "Type",
                "coalesce(Specialty, '')", "coalesce(Edition, '')"])


def _decided(by_row: bool) -> str:
    """Suggested winner by walking the candidates of a conflict in order (recursive)."""
    if by_row:
        better = "c.ms > w.ms OR (c.ms = w.ms AND c.bms > w.bms)"
        worse = "c.ms < w.ms OR (c.ms = w.ms AND c.bms < w.bms)"
        basis = "CASE WHEN c.ms <> w.ms THEN 'row' ELSE 'backup' END"
    else:
        better, worse, basis = "c.bms > w.bms", "c.bms < w.bms", "'snapshot'"
    return f"""
      SELECT conflict_id, nth, src AS best, ms, bms, 'tie' AS decided FROM x WHERE nth = 1
      UNION ALL
      SELECT c.conflict_id, c.nth, CASE WHEN {better} THEN c.src ELSE w.best END,
        CASE WHEN {better} THEN c.ms ELSE w.ms END, CASE WHEN {better} THEN c.bms ELSE w.bms END,
        CASE WHEN {better} THEN {basis} WHEN ({worse}) AND w.decided = 'tie' THEN {basis} ELSE w.decided END
      FROM w JOIN x c ON c.conflict_id = w.conflict_id AND c.nth = w.nth + 1"""


def _suggest(cands: str, by_row: bool) -> str:
    return f"""
      WITH RECURSIVE x AS (SELECT conflict_id, src, {millis('timestamp')} AS ms, {millis('backup_timestamp')} AS bms,
          row_number() OVER (PARTITION BY conflict_id ORDER BY src, pk) AS nth FROM {cands}),
        w AS ({_decided(by_row)})
      SELECT conflict_id, max(nth) AS n_candidates, arg_max(best, nth) AS suggested_src, arg_max(decided, nth) AS decided_by
      FROM w GROUP BY conflict_id"""


CTES = {
    **{f"s_{n}": derive.oracle_text(n) for n in derive.DERIVED},
    **{f"d_{n}": derive.damaged_text(n, f"s_{n}") for n in derive.DAMAGE},
    "info": """SELECT src, LastModified, base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS label FROM (
        SELECT src, LastModified, DeviceName AS base, row_number() OVER (PARTITION BY DeviceName ORDER BY src) AS n FROM s_sources)""",
    # ---- locations: n-th row of a full key in a source is the n-th entity
    "loc_occ": f"SELECT *, {ord_('LocationId')} AS o, row_number() OVER (PARTITION BY src, {_F} ORDER BY LocationId) AS occ FROM s_Location",
    "loc_first": f"SELECT *, min(o) OVER (PARTITION BY {_F}, occ) AS f FROM loc_occ",
    "loc": "SELECT src, LocationId, Title, o, f, dense_rank() OVER (ORDER BY f) AS gid, o <> f AS into_ FROM loc_first",
    "m_Location": f"""SELECT l.gid AS LocationId, {', '.join('any_value(s.' + c + ') FILTER (l.o = l.f) AS ' + c for c in _LOC)},
        coalesce(arg_min(l.Title, l.o) FILTER ({trim("coalesce(l.Title, '')")} <> ''),
          any_value(l.Title) FILTER (l.o = l.f), ' ') AS Title,
        arg_min(l.Title, l.o) FILTER ({trim("coalesce(l.Title, '')")} <> '') IS NULL
          AND any_value(l.Title) FILTER (l.o = l.f) IS NULL AS title_normalized
        FROM loc l JOIN s_Location s ON s.src = l.src AND s.LocationId = l.LocationId GROUP BY l.gid""",
    "where_": f"SELECT LocationId, {describe()} AS text FROM m_Location",
    # ---- highlights
    "um_all": f"""SELECT u.*, {ord_('u.UserMarkId', 'u.src')} AS o, l.gid AS loc FROM s_UserMark u
        LEFT JOIN loc l ON l.src = u.src AND l.LocationId = u.LocationId""",
    "um_gid": "SELECT UserMarkGuid, dense_rank() OVER (ORDER BY min(o)) AS gid FROM um_all GROUP BY UserMarkGuid",
    "rsig": """SELECT *, concat_ws('|', BlockType, Identifier, coalesce(CAST(StartToken AS VARCHAR), '-'),
        coalesce(CAST(EndToken AS VARCHAR), '-')) AS sig FROM s_BlockRange""",
    "rset": "SELECT src, UserMarkId, string_agg(sig, ',' ORDER BY sig) AS rs FROM rsig GROUP BY src, UserMarkId",
    "um_copy": """SELECT u.*, g.gid, concat_ws('/', ColorIndex, StyleIndex, Version, loc, coalesce(rs, '')) AS look FROM um_all u
        JOIN um_gid g USING (UserMarkGuid) LEFT JOIN rset r ON r.src = u.src AND r.UserMarkId = u.UserMarkId WHERE loc IS NOT NULL""",
    "um_grp": "SELECT gid, count(DISTINCT look) > 1 AS conflict, min(o) AS f, count(*) AS n FROM um_copy GROUP BY gid",
    "um": "SELECT c.*, g.conflict, g.f, g.n FROM um_copy c JOIN um_grp g USING (gid)",
    "m_UserMark": "SELECT gid AS UserMarkId, ColorIndex, loc AS LocationId, StyleIndex, UserMarkGuid, Version FROM um WHERE NOT conflict AND o = f",
    "um_cand": """SELECT 'userMark:' || UserMarkGuid AS conflict_id, u.src, UserMarkId AS pk, label, gid, i.LastModified AS timestamp,
        'backup' AS timestamp_source, i.LastModified AS backup_timestamp, UserMarkGuid AS identity_key, loc, o FROM um u
        JOIN info i ON i.src = u.src WHERE conflict""",
    "um_pick": _suggest("um_cand", False),
    # ---- ranges
    "br_own": f"""SELECT r.src, r.BlockRangeId, r.BlockType, r.Identifier, r.StartToken, r.EndToken, r.sig, r.UserMarkId, u.gid AS mark, u.o AS mo,
        u.conflict, u.f, u.UserMarkGuid FROM rsig r JOIN um u ON u.src = r.src AND u.UserMarkId = r.UserMarkId""",
    "br_kept": "SELECT *, row_number() OVER (ORDER BY mark, src, UserMarkId, BlockRangeId) AS gid FROM br_own WHERE conflict OR mo = f",
    "m_BlockRange": """SELECT gid AS BlockRangeId, BlockType, Identifier, StartToken, EndToken, mark AS UserMarkId FROM br_kept WHERE NOT conflict""",
    "br_pair": """SELECT o.src, o.BlockRangeId, k.gid FROM (SELECT *, row_number() OVER (PARTITION BY src, UserMarkId, sig ORDER BY BlockRangeId) AS n
          FROM br_own WHERE NOT conflict AND mo <> f) o
        LEFT JOIN (SELECT mark, sig, gid, row_number() OVER (PARTITION BY mark, sig ORDER BY BlockRangeId) AS n FROM br_kept WHERE NOT conflict) k
        ON k.mark = o.mark AND k.sig = o.sig AND k.n = o.n""",
    # ---- media
    "md_occ": f"SELECT *, {ord_('IndependentMediaId')} AS o, row_number() OVER (PARTITION BY src, Hash ORDER BY IndependentMediaId) AS occ FROM s_IndependentMedia",
    "md": "SELECT *, dense_rank() OVER (ORDER BY f) AS gid FROM (SELECT *, min(o) OVER (PARTITION BY Hash, occ) AS f FROM md_occ)",
    "md_new": """SELECT *, row_number() OVER (PARTITION BY lower(FilePath) ORDER BY gid) > 1 AS renamed FROM md WHERE o = f""",
    "md_named": f"""SELECT *, CASE WHEN renamed THEN {guid("(Hash || '|' || FilePath || '|' || n)")} || {ext('FilePath')} ELSE FilePath END AS new_path
        FROM (SELECT *, row_number() OVER (PARTITION BY Hash, FilePath, renamed ORDER BY gid) - 1 AS n FROM md_new)""",
    "m_IndependentMedia": "SELECT gid AS IndependentMediaId, OriginalFilename, new_path AS FilePath, MimeType, Hash FROM md_named",
    "md_path": "SELECT m.src, m.IndependentMediaId, m.FilePath, m.gid, m.o, m.f, n.new_path FROM md m JOIN md_named n ON n.gid = m.gid",
    "md_held": """SELECT p.gid, any_value(p.new_path) AS FilePath, arg_min(p.src, p.o) AS src, arg_min(p.FilePath, p.o) AS path FROM md_path p
        JOIN s_media_files f ON f.src = p.src AND f.path = p.FilePath GROUP BY p.gid""",
    # ---- notes
    "nt_all": f"""SELECT n.*, {ord_('n.NoteId', 'n.src')} AS o, {millis('n.LastModified')} AS ms, u.gid AS mark, l.gid AS loc,
        {norm('n.Title')} || chr(30) || {norm('n.Content')} AS look FROM s_Note n
        LEFT JOIN um u ON u.src = n.src AND u.UserMarkId = n.UserMarkId LEFT JOIN loc l ON l.src = n.src AND l.LocationId = n.LocationId""",
    "nt_grp": "SELECT Guid, dense_rank() OVER (ORDER BY min(o)) AS gid, count(DISTINCT look) > 1 AS conflict FROM nt_all GROUP BY Guid",
    "nt": """SELECT a.*, g.gid, g.conflict, row_number() OVER (PARTITION BY a.Guid ORDER BY ms DESC, o) = 1 AS wins
        FROM nt_all a JOIN nt_grp g USING (Guid)""",
    "nt_rows": "SELECT gid AS NoteId, Guid, mark AS UserMarkId, loc AS LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier, conflict, wins, src, NoteId AS pk, o FROM nt",
    "m_Note": "SELECT NoteId, Guid, UserMarkId, LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier FROM nt_rows WHERE NOT conflict AND wins",
    "nt_cand": """SELECT 'note:' || n.Guid AS conflict_id, n.src, n.NoteId AS pk, label, gid, n.LastModified AS timestamp, 'row' AS timestamp_source,
        i.LastModified AS backup_timestamp, n.Guid AS identity_key, loc, o, Title, Content FROM nt n JOIN info i ON i.src = n.src WHERE conflict""",
    "nt_pick": _suggest("nt_cand", True),
    # ---- bookmarks
    "bm_all": f"""SELECT b.*, {ord_('b.BookmarkId', 'b.src')} AS o, p.gid AS pub, l.gid AS loc FROM s_Bookmark b
        LEFT JOIN loc p ON p.src = b.src AND p.LocationId = b.PublicationLocationId
        LEFT JOIN loc l ON l.src = b.src AND l.LocationId = b.LocationId""",
    "bm_occ": """SELECT *, row_number() OVER (PARTITION BY src, pub, loc, BlockType, BlockIdentifier ORDER BY BookmarkId) AS occ
        FROM bm_all WHERE pub IS NOT NULL AND loc IS NOT NULL""",
    "bm": "SELECT *, dense_rank() OVER (ORDER BY f) AS gid FROM (SELECT *, min(o) OVER (PARTITION BY pub, loc, BlockType, BlockIdentifier, occ) AS f FROM bm_occ)",
    "bm_new": "SELECT *, row_number() OVER (PARTITION BY pub ORDER BY gid) AS nth FROM bm WHERE o = f",
    "bm_slot": """WITH RECURSIVE w AS (
          SELECT pub, gid, nth, Slot AS slot, [Slot] AS used FROM bm_new WHERE nth = 1
          UNION ALL
          SELECT c.pub, c.gid, c.nth, c.slot, list_append(c.used, c.slot) FROM (
            SELECT n.pub, n.gid, n.nth, w.used, CASE WHEN list_contains(w.used, n.Slot)
              THEN CAST(list_min(list_filter(range(0, len(w.used) + 1), lambda v: NOT list_contains(w.used, CAST(v AS INT)))) AS INT) ELSE n.Slot END AS slot
            FROM w JOIN bm_new n ON n.pub = w.pub AND n.nth = w.nth + 1) c)
        SELECT gid, slot FROM w""",
    "m_Bookmark": """SELECT n.gid AS BookmarkId, n.loc AS LocationId, n.pub AS PublicationLocationId, s.slot AS Slot, n.Title, n.Snippet, n.BlockType,
        n.BlockIdentifier FROM bm_new n JOIN bm_slot s USING (gid)""",
    # ---- input fields
    "if_all": f"""SELECT f.*, l.gid AS loc, {ord_('f.LocationId', 'f.src')} AS o, {norm('f.Value')} AS look, {millis('i.LastModified')} AS bms,
        i.LastModified AS stamp, label FROM s_InputField f JOIN info i ON i.src = f.src LEFT JOIN loc l ON l.src = f.src AND l.LocationId = f.LocationId""",
    "if_grp": "SELECT loc, TextTag, count(DISTINCT look) > 1 AS conflict FROM if_all WHERE loc IS NOT NULL GROUP BY loc, TextTag",
    "fld": f"""SELECT a.*, g.conflict, a.loc || {_SEP} || a.TextTag AS ident,
        row_number() OVER (PARTITION BY a.loc, a.TextTag ORDER BY bms DESC, o) = 1 AS wins FROM if_all a JOIN if_grp g USING (loc, TextTag)""",
    "m_InputField": "SELECT loc AS LocationId, TextTag, Value FROM fld WHERE NOT conflict AND wins",
    "if_cand": """SELECT 'inputField:' || ident AS conflict_id, src, LocationId AS pk, label, loc AS gid, stamp AS timestamp, 'backup' AS timestamp_source,
        stamp AS backup_timestamp, ident AS identity_key, loc, o, TextTag, Value FROM fld WHERE conflict""",
    "if_pick": _suggest("if_cand", False),
    # ---- tags and accuracies
    "tg": f"""SELECT *, dense_rank() OVER (ORDER BY f) AS gid FROM (SELECT *, {ord_('TagId')} AS o, min({ord_('TagId')}) OVER (PARTITION BY Type, Name) AS f FROM s_Tag)""",
    "m_Tag": "SELECT gid AS TagId, Type, Name FROM tg WHERE o = f",
    "ac": f"""SELECT *, dense_rank() OVER (ORDER BY f) AS gid FROM (SELECT *, {ord_('PlaylistItemAccuracyId')} AS o,
        min({ord_('PlaylistItemAccuracyId')}) OVER (PARTITION BY Description) AS f FROM s_PlaylistItemAccuracy)""",
    "m_PlaylistItemAccuracy": "SELECT gid AS PlaylistItemAccuracyId, Description FROM ac WHERE o = f",
    # ---- playlist items
    "il": """SELECT m.*, l.gid AS loc FROM s_PlaylistItemLocationMap m LEFT JOIN loc l ON l.src = m.src AND l.LocationId = m.LocationId""",
    "im": """SELECT m.*, d.gid AS med, d.Hash AS hash FROM s_PlaylistItemIndependentMediaMap m
        LEFT JOIN md d ON d.src = m.src AND d.IndependentMediaId = m.IndependentMediaId""",
    "ilx": """SELECT src, PlaylistItemId, string_agg(x, ',' ORDER BY x) AS places FROM (SELECT *, concat_ws('|', coalesce(CAST(loc AS VARCHAR), '?' || LocationId),
        MajorMultimediaType, coalesce(CAST(BaseDurationTicks AS VARCHAR), '-')) AS x FROM il) GROUP BY src, PlaylistItemId""",
    "imx": """SELECT src, PlaylistItemId, string_agg(x, ',' ORDER BY x) AS media FROM (SELECT *, coalesce(hash, '?' || IndependentMediaId) || '|' || DurationTicks AS x FROM im)
        GROUP BY src, PlaylistItemId""",
    "vx": "SELECT src, PlaylistItemMarkerId, string_agg(CAST(VerseId AS VARCHAR), ',' ORDER BY VerseId) AS v FROM s_PlaylistItemMarkerBibleVerseMap GROUP BY ALL",
    "px": """SELECT src, PlaylistItemMarkerId, string_agg(x, ',' ORDER BY x) AS p FROM (SELECT *, concat_ws('|', MepsDocumentId, ParagraphIndex, MarkerIndexWithinParagraph) AS x
        FROM s_PlaylistItemMarkerParagraphMap) GROUP BY src, PlaylistItemMarkerId""",
    "kx": """SELECT src, PlaylistItemId, string_agg(x, ';' ORDER BY x) AS marks FROM (SELECT k.src, k.PlaylistItemId, concat_ws('|', Label, StartTimeTicks, DurationTicks,
        EndTransitionDurationTicks, coalesce(v, ''), coalesce(p, '')) AS x FROM s_PlaylistItemMarker k
        LEFT JOIN vx ON vx.src = k.src AND vx.PlaylistItemMarkerId = k.PlaylistItemMarkerId
        LEFT JOIN px ON px.src = k.src AND px.PlaylistItemMarkerId = k.PlaylistItemMarkerId) GROUP BY src, PlaylistItemId""",
    "it_all": f"""SELECT i.*, {ord_('i.PlaylistItemId', 'i.src')} AS o, a.gid AS acc, t.new_path AS thumb, md5(concat_ws(chr(30), i.Label,
        coalesce(CAST(StartTrimOffsetTicks AS VARCHAR), '-'), coalesce(CAST(EndTrimOffsetTicks AS VARCHAR), '-'), EndAction, coalesce(a.Description, '-'),
        coalesce(h.Hash, '-'), coalesce(places, ''), coalesce(media, ''), coalesce(marks, ''))) AS sig
        FROM s_PlaylistItem i LEFT JOIN ac a ON a.src = i.src AND a.PlaylistItemAccuracyId = i.Accuracy
        LEFT JOIN md h ON h.src = i.src AND h.FilePath = i.ThumbnailFilePath
        LEFT JOIN md_path t ON t.src = i.src AND t.FilePath = i.ThumbnailFilePath
        LEFT JOIN ilx ON ilx.src = i.src AND ilx.PlaylistItemId = i.PlaylistItemId LEFT JOIN imx ON imx.src = i.src AND imx.PlaylistItemId = i.PlaylistItemId
        LEFT JOIN kx ON kx.src = i.src AND kx.PlaylistItemId = i.PlaylistItemId""",
    "it": """SELECT *, dense_rank() OVER (ORDER BY f) AS gid FROM (SELECT *, min(o) OVER (PARTITION BY sig, occ) AS f FROM (
        SELECT *, row_number() OVER (PARTITION BY src, sig ORDER BY PlaylistItemId) AS occ FROM it_all WHERE acc IS NOT NULL))""",
    "m_PlaylistItem": """SELECT gid AS PlaylistItemId, Label, StartTrimOffsetTicks, EndTrimOffsetTicks, acc AS Accuracy, EndAction, thumb AS ThumbnailFilePath
        FROM it WHERE o = f""",
    # fate of an item's children: item null = dropped, own = the item was created from this row
    "fate": "SELECT a.src, a.PlaylistItemId, i.gid AS item, coalesce(i.o = i.f, false) AS own FROM it_all a LEFT JOIN it i ON i.src = a.src AND i.PlaylistItemId = a.PlaylistItemId",
    "ilf": """SELECT il.*, item, own, CASE WHEN own AND loc IS NOT NULL THEN row_number() OVER (PARTITION BY item, loc, own ORDER BY LocationId) END AS nth
        FROM il JOIN fate USING (src, PlaylistItemId)""",
    "m_PlaylistItemLocationMap": "SELECT item AS PlaylistItemId, loc AS LocationId, MajorMultimediaType, BaseDurationTicks FROM ilf WHERE nth = 1",
    "imf": """SELECT im.*, item, own, CASE WHEN own AND med IS NOT NULL THEN row_number() OVER (PARTITION BY item, med, own ORDER BY IndependentMediaId) END AS nth
        FROM im JOIN fate USING (src, PlaylistItemId)""",
    "m_PlaylistItemIndependentMediaMap": "SELECT item AS PlaylistItemId, med AS IndependentMediaId, DurationTicks FROM imf WHERE nth = 1",
    "kf": """SELECT k.*, item, own, CASE WHEN own THEN row_number() OVER (PARTITION BY item, own, StartTimeTicks ORDER BY PlaylistItemMarkerId) END AS nth
        FROM s_PlaylistItemMarker k JOIN fate USING (src, PlaylistItemId)""",
    "kg": "SELECT item, StartTimeTicks, row_number() OVER (ORDER BY item, PlaylistItemMarkerId) AS gid, PlaylistItemMarkerId AS kept FROM kf WHERE nth = 1",
    "km": "SELECT kf.*, kg.gid, kg.kept FROM kf LEFT JOIN kg ON kg.item = kf.item AND kg.StartTimeTicks = kf.StartTimeTicks",
    "m_PlaylistItemMarker": "SELECT gid AS PlaylistItemMarkerId, item AS PlaylistItemId, Label, StartTimeTicks, DurationTicks, EndTransitionDurationTicks FROM km WHERE nth = 1",
    "m_PlaylistItemMarkerBibleVerseMap": """SELECT DISTINCT k.gid AS PlaylistItemMarkerId, VerseId FROM s_PlaylistItemMarkerBibleVerseMap v
        JOIN km k USING (src, PlaylistItemMarkerId) WHERE k.nth = 1""",
    "m_PlaylistItemMarkerParagraphMap": """SELECT DISTINCT k.gid AS PlaylistItemMarkerId, MepsDocumentId, ParagraphIndex, MarkerIndexWithinParagraph
        FROM s_PlaylistItemMarkerParagraphMap p JOIN km k USING (src, PlaylistItemMarkerId) WHERE k.nth = 1""",
    # ---- tag assignments: walk the kept rows of every tag in order
    "tm_all": """SELECT m.*, t.gid AS tag, min(TagMapId) OVER (PARTITION BY m.src, m.TagId) AS rk,
        CASE WHEN m.NoteId IS NOT NULL THEN 'N' WHEN m.LocationId IS NOT NULL THEN 'L' WHEN m.PlaylistItemId IS NOT NULL THEN 'P' END AS kind,
        CASE WHEN m.NoteId IS NOT NULL THEN n.gid WHEN m.LocationId IS NOT NULL THEN l.gid ELSE i.gid END AS ref
        FROM s_TagMap m LEFT JOIN tg t ON t.src = m.src AND t.TagId = m.TagId LEFT JOIN nt n ON n.src = m.src AND n.NoteId = m.NoteId
        LEFT JOIN loc l ON l.src = m.src AND l.LocationId = m.LocationId LEFT JOIN it i ON i.src = m.src AND i.PlaylistItemId = m.PlaylistItemId""",
    "tm_seq": """SELECT *, row_number() OVER (ORDER BY src, rk, Position, TagMapId) AS seq FROM tm_all""",
    "tm_live": """SELECT *, row_number() OVER (PARTITION BY tag, kind, ref ORDER BY seq) AS dup FROM tm_seq WHERE tag IS NOT NULL AND ref IS NOT NULL""",
    "tm_own": "SELECT tag, min(src * 10000000000000000 + rk) AS owner FROM tm_seq WHERE tag IS NOT NULL GROUP BY tag",
    "tm_new": """SELECT l.*, o.owner = l.src * 10000000000000000 + l.rk AS mine, row_number() OVER (PARTITION BY l.tag ORDER BY seq) AS nth,
        row_number() OVER (ORDER BY seq) AS gid FROM tm_live l JOIN tm_own o USING (tag) WHERE dup = 1""",
    # the last position taken by the first contributor grows with its own positions
    "tm_pos": """SELECT *, CASE WHEN mine THEN top + nth ELSE base + row_number() OVER (PARTITION BY tag, mine ORDER BY seq) END AS pos FROM (
        SELECT *, coalesce(max(CASE WHEN mine THEN top + nth END) OVER (PARTITION BY tag), -1) AS base FROM (
          SELECT *, max(CASE WHEN mine THEN Position - nth END) OVER (PARTITION BY tag ORDER BY seq) AS top FROM tm_new))""",
    "m_TagMap": """SELECT gid AS TagMapId, CASE WHEN kind = 'P' THEN ref END AS PlaylistItemId, CASE WHEN kind = 'L' THEN ref END AS LocationId,
        CASE WHEN kind = 'N' THEN ref END AS NoteId, tag AS TagId, CAST(pos AS BIGINT) AS Position FROM tm_pos""",
    # ---- decisions
    "cand": """SELECT conflict_id, 'userMark' AS kind, src, gid, o, pk FROM um_cand UNION ALL SELECT conflict_id, 'note', src, gid, o, pk FROM nt_cand
        UNION ALL SELECT conflict_id, 'inputField', src, gid, o, pk FROM if_cand""",
    "pick": "SELECT * FROM um_pick UNION ALL SELECT * FROM nt_pick UNION ALL SELECT * FROM if_pick",
    "conf": "SELECT p.*, c.kind, c.gid FROM pick p JOIN (SELECT conflict_id, any_value(kind) AS kind, any_value(gid) AS gid FROM cand GROUP BY conflict_id) c USING (conflict_id)",
    "verdict": """SELECT f.*, CAST(gid % 4 - 1 AS INT) AS choice, gid % 4 = 0 AND kind IN ('note', 'userMark') AS kept,
        coalesce((SELECT c.src FROM cand c WHERE c.conflict_id = f.conflict_id AND c.src = f.gid % 4 - 1), suggested_src) AS win FROM conf f""",
    "f_Note": """SELECT NoteId, Guid, UserMarkId, LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier FROM m_Note
        UNION ALL SELECT NoteId, Guid, UserMarkId, LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier FROM nt_rows n
        JOIN nt_pick p ON p.conflict_id = 'note:' || n.Guid AND p.suggested_src = n.src WHERE conflict""",
    "f_UserMark": """SELECT * FROM m_UserMark UNION ALL SELECT gid, ColorIndex, loc, StyleIndex, UserMarkGuid, Version FROM um u
        JOIN um_pick p ON p.conflict_id = 'userMark:' || u.UserMarkGuid AND p.suggested_src = u.src""",
    "f_BlockRange": """SELECT * FROM m_BlockRange UNION ALL SELECT gid, BlockType, Identifier, StartToken, EndToken, mark FROM br_kept b
        JOIN um_pick p ON p.conflict_id = 'userMark:' || b.UserMarkGuid AND p.suggested_src = b.src""",
    "f_InputField": """SELECT * FROM m_InputField UNION ALL SELECT f.loc, f.TextTag, f.Value FROM fld f
        JOIN if_pick p ON p.conflict_id = 'inputField:' || f.ident AND p.suggested_src = f.src""",
    **{f"f_{t}": f"SELECT {', '.join(schema.columns(t))} FROM m_{t}" for t in schema.TABLES if t not in ("Note", "UserMark", "BlockRange", "InputField")},
    "x_notes": f"""SELECT n.*, v.conflict_id, (SELECT max(gid) FROM nt) + row_number() OVER (ORDER BY n.NoteId, n.src, n.pk) AS fresh FROM nt_rows n
        JOIN verdict v ON v.conflict_id = 'note:' || n.Guid WHERE v.kept AND n.src <> v.win""",
    "x_marks": f"""SELECT u.*, v.conflict_id, (SELECT max(gid) FROM um) + row_number() OVER (ORDER BY u.gid, u.src, u.UserMarkId) AS fresh FROM um u
        JOIN verdict v ON v.conflict_id = 'userMark:' || u.UserMarkGuid WHERE v.kept AND u.src <> v.win""",
}

# ---- clean-ups on the default result
CTES |= {
    "fp": "SELECT UserMarkId, string_agg(sig, ',' ORDER BY sig) AS rs FROM (SELECT *, concat_ws('|', BlockType, Identifier, coalesce(CAST(StartToken AS VARCHAR), '-'), coalesce(CAST(EndToken AS VARCHAR), '-')) AS sig FROM f_BlockRange) GROUP BY UserMarkId",
    "gone_notes": f"SELECT NoteId FROM f_Note WHERE {norm('Title')} = '' AND {norm('Content')} = '' AND NoteId NOT IN (SELECT NoteId FROM m_TagMap WHERE NoteId IS NOT NULL)",
    "gone_marks": "SELECT UserMarkId FROM f_UserMark WHERE UserMarkId NOT IN (SELECT UserMarkId FROM f_BlockRange)",
    "dup_marks": """SELECT UserMarkId, keeper FROM (SELECT u.UserMarkId, first_value(u.UserMarkId) OVER (PARTITION BY LocationId, ColorIndex, StyleIndex, rs
        ORDER BY coalesce(n, 0) DESC, u.UserMarkId) AS keeper FROM f_UserMark u JOIN fp ON fp.UserMarkId = u.UserMarkId
        LEFT JOIN (SELECT UserMarkId, count(*) AS n FROM f_Note WHERE UserMarkId IS NOT NULL GROUP BY UserMarkId) c ON c.UserMarkId = u.UserMarkId) WHERE UserMarkId <> keeper""",
    "gone_media": """SELECT IndependentMediaId FROM m_IndependentMedia WHERE IndependentMediaId NOT IN (SELECT IndependentMediaId FROM m_PlaylistItemIndependentMediaMap)
        AND FilePath NOT IN (SELECT ThumbnailFilePath FROM m_PlaylistItem WHERE ThumbnailFilePath IS NOT NULL)""",
    "gone_lists": "SELECT TagId FROM m_Tag WHERE Type = 2 AND TagId NOT IN (SELECT TagId FROM m_TagMap)",
    # all clean-ups in order; duplicate keepers count notes after the other two steps
    "c_Note1": """SELECT NoteId, LocationId, CASE WHEN UserMarkId IN (SELECT UserMarkId FROM gone_marks) THEN NULL ELSE UserMarkId END AS UserMarkId,
        UserMarkId IN (SELECT UserMarkId FROM gone_marks) AS detached FROM f_Note WHERE NoteId NOT IN (SELECT NoteId FROM gone_notes)""",
    "c_dup": """SELECT UserMarkId, keeper FROM (SELECT u.UserMarkId, first_value(u.UserMarkId) OVER (PARTITION BY LocationId, ColorIndex, StyleIndex, rs
        ORDER BY coalesce(n, 0) DESC, u.UserMarkId) AS keeper FROM f_UserMark u JOIN fp ON fp.UserMarkId = u.UserMarkId
        LEFT JOIN (SELECT UserMarkId, count(*) AS n FROM c_Note1 WHERE UserMarkId IS NOT NULL GROUP BY UserMarkId) c ON c.UserMarkId = u.UserMarkId) WHERE UserMarkId <> keeper""",
    "c_UserMark": "SELECT * FROM f_UserMark WHERE UserMarkId NOT IN (SELECT UserMarkId FROM gone_marks) AND UserMarkId NOT IN (SELECT UserMarkId FROM c_dup)",
    "c_refs": """SELECT LocationId AS id FROM c_Note1 WHERE LocationId IS NOT NULL UNION SELECT LocationId FROM c_UserMark UNION SELECT LocationId FROM m_Bookmark
        UNION SELECT PublicationLocationId FROM m_Bookmark UNION SELECT LocationId FROM f_InputField UNION SELECT LocationId FROM m_TagMap WHERE LocationId IS NOT NULL
        UNION SELECT LocationId FROM m_PlaylistItemLocationMap""",
    "f_refs": """SELECT LocationId AS id FROM f_Note WHERE LocationId IS NOT NULL UNION SELECT LocationId FROM f_UserMark UNION SELECT LocationId FROM m_Bookmark
        UNION SELECT PublicationLocationId FROM m_Bookmark UNION SELECT LocationId FROM f_InputField UNION SELECT LocationId FROM m_TagMap WHERE LocationId IS NOT NULL
        UNION SELECT LocationId FROM m_PlaylistItemLocationMap""",
    "cleaned": """SELECT 'emptyNotes' AS name, count(*) AS n FROM gone_notes UNION ALL SELECT 'rangelessHighlights', count(*) FROM gone_marks
        UNION ALL SELECT 'notesDetached', count(*) FROM c_Note1 WHERE detached UNION ALL SELECT 'duplicateHighlights', count(*) FROM c_dup
        UNION ALL SELECT 'notesReattached', count(*) FROM c_Note1 WHERE UserMarkId IN (SELECT UserMarkId FROM c_dup)
        UNION ALL SELECT 'unusedMedia', count(*) FROM gone_media UNION ALL SELECT 'emptyPlaylists', count(*) FROM gone_lists
        UNION ALL SELECT 'unreferencedLocations', count(*) FROM m_Location WHERE LocationId NOT IN (SELECT id FROM c_refs)""",
    "lost": """SELECT 'Note' AS "table", count(*) AS n FROM gone_notes UNION ALL SELECT 'UserMark', (SELECT count(*) FROM gone_marks) + (SELECT count(*) FROM c_dup)
        UNION ALL SELECT 'BlockRange', count(*) FROM f_BlockRange WHERE UserMarkId IN (SELECT UserMarkId FROM c_dup)
        UNION ALL SELECT 'IndependentMedia', count(*) FROM gone_media UNION ALL SELECT 'Tag', count(*) FROM gone_lists
        UNION ALL SELECT 'Location', count(*) FROM m_Location WHERE LocationId NOT IN (SELECT id FROM c_refs)""",
}


# ---- lineage
def _line(local: str, kind: str, key: str, into: str, conflict: str = "NULL", reason: str = "NULL") -> str:
    return (
        f"SELECT src, CAST({local} AS VARCHAR) AS local_key, {kind} AS kind, CAST({key} AS VARCHAR) AS global_key, "
        f"CAST({into} AS BOOLEAN) AS merged_into, CAST({conflict} AS VARCHAR) AS conflict_id, CAST({reason} AS VARCHAR) AS reason"
    )


def _dropped(local: str, reason: str, source: str) -> str:
    return _line(local, "'dropped'", "NULL", "NULL", "NULL", reason) + " FROM " + source


_kind = "CASE WHEN conflict THEN 'conflict' ELSE 'mapped' END"
_child_reason = "CASE WHEN item IS NULL THEN 'parent playlist item dropped' WHEN own THEN '%s' ELSE 'no matching child on the winning copy' END"


def _link(rows: str, ref: str, local: str, trace: str, own: str) -> str:
    key = f"item || {_SEP} || {ref}"
    return f"""
      SELECT r.src, r.PlaylistItemId || {_SEP} || r.{local} AS local_key, CASE WHEN g IS NULL THEN 'dropped' ELSE 'mapped' END AS kind, g AS global_key,
        CASE WHEN g IS NOT NULL THEN NOT own OR nth <> 1 END AS merged_into, CAST(NULL AS VARCHAR) AS conflict_id,
        CASE WHEN g IS NULL THEN {_child_reason % own} END AS reason
      FROM (SELECT r.*, CASE WHEN own THEN CASE WHEN {ref} IS NOT NULL THEN {key} END ELSE t.g2 END AS g FROM {rows} r
        LEFT JOIN (SELECT item AS item2, {trace} AS t2, arg_max({key}, {local}) AS g2 FROM {rows} WHERE nth = 1 GROUP BY item, {trace}) t
        ON t.item2 = r.item AND t.t2 = {trace}) r"""


def _detail(table: str, rest: str) -> str:
    parts = f" || {_SEP} || ".join(rest.split(", "))
    return f"""
      SELECT v.src, PlaylistItemMarkerId || {_SEP} || {parts} AS local_key, CASE WHEN gid IS NULL THEN 'dropped' ELSE 'mapped' END AS kind,
        gid || {_SEP} || {parts} AS global_key, CASE WHEN gid IS NOT NULL THEN NOT own END AS merged_into, CAST(NULL AS VARCHAR) AS conflict_id,
        CASE WHEN gid IS NULL THEN {_child_reason % ''} END AS reason
      FROM s_{table} v JOIN (SELECT src, PlaylistItemMarkerId, gid, item, own FROM km WHERE NOT own OR PlaylistItemMarkerId = kept) k
      USING (src, PlaylistItemMarkerId)"""


LINEAGE = {
    "Location": _line("LocationId", "'mapped'", "gid", "into_") + " FROM loc",
    "UserMark": _line("UserMarkId", _kind, "gid", "CASE WHEN NOT conflict THEN o <> f END", "CASE WHEN conflict THEN 'userMark:' || UserMarkGuid END")
    + " FROM um UNION ALL " + _dropped("UserMarkId", "'dangling LocationId'", "um_all WHERE loc IS NULL"),
    "IndependentMedia": _line("IndependentMediaId", "'mapped'", "gid", "o <> f") + " FROM md",
    "BlockRange": _line("BlockRangeId", _kind, "gid", "CASE WHEN NOT conflict THEN false END", "CASE WHEN conflict THEN 'userMark:' || UserMarkGuid END")
    + " FROM br_kept UNION ALL " + _line("BlockRangeId", "CASE WHEN gid IS NULL THEN 'dropped' ELSE 'mapped' END", "gid", "CASE WHEN gid IS NOT NULL THEN true END",
                                         "NULL", "CASE WHEN gid IS NULL THEN 'unpaired duplicate' END") + " FROM br_pair UNION ALL "
    + _dropped("BlockRangeId", "'dangling UserMarkId'", "s_BlockRange b WHERE NOT EXISTS (SELECT 1 FROM um u WHERE u.src = b.src AND u.UserMarkId = b.UserMarkId)"),
    "Note": _line("NoteId", _kind, "gid", "CASE WHEN NOT conflict THEN NOT wins END", "CASE WHEN conflict THEN 'note:' || Guid END") + " FROM nt",
    "Bookmark": _line("BookmarkId", "'mapped'", "gid", "o <> f") + " FROM bm UNION ALL "
    + _dropped("BookmarkId", "'dangling LocationId'", "bm_all WHERE pub IS NULL OR loc IS NULL"),
    "InputField": _line(f"LocationId || {_SEP} || TextTag", _kind, "ident", "CASE WHEN NOT conflict THEN NOT wins END", "CASE WHEN conflict THEN 'inputField:' || ident END")
    + " FROM fld UNION ALL " + _dropped(f"LocationId || {_SEP} || TextTag", "'dangling LocationId'", "if_all WHERE loc IS NULL"),
    "Tag": _line("TagId", "'mapped'", "gid", "o <> f") + " FROM tg",
    "PlaylistItemAccuracy": _line("PlaylistItemAccuracyId", "'mapped'", "gid", "o <> f") + " FROM ac",
    "PlaylistItem": _line("PlaylistItemId", "'mapped'", "gid", "o <> f") + " FROM it UNION ALL "
    + _dropped("PlaylistItemId", "'dangling Accuracy'", "it_all WHERE acc IS NULL"),
    "PlaylistItemLocationMap": _link("ilf", "loc", "LocationId", "concat_ws('|', loc, MajorMultimediaType, coalesce(CAST(BaseDurationTicks AS VARCHAR), '-'))", "dangling LocationId"),
    "PlaylistItemIndependentMediaMap": _link("imf", "med", "IndependentMediaId", "concat_ws('|', hash, DurationTicks)", "dangling IndependentMediaId"),
    "PlaylistItemMarker": _line("PlaylistItemMarkerId", "CASE WHEN gid IS NULL THEN 'dropped' ELSE 'mapped' END", "gid",
                                "CASE WHEN gid IS NOT NULL THEN NOT own OR PlaylistItemMarkerId <> kept END", "NULL",
                                f"CASE WHEN gid IS NULL THEN {_child_reason % 'repeated start time'} END") + " FROM km",
    "PlaylistItemMarkerBibleVerseMap": _detail("PlaylistItemMarkerBibleVerseMap", "VerseId"),
    "PlaylistItemMarkerParagraphMap": _detail("PlaylistItemMarkerParagraphMap", "MepsDocumentId, ParagraphIndex, MarkerIndexWithinParagraph"),
    "TagMap": _line("l.TagMapId", "'mapped'", "n.gid", "l.dup <> 1").replace("SELECT src", "SELECT l.src")
    + " FROM tm_live l JOIN tm_new n ON n.tag = l.tag AND n.kind = l.kind AND n.ref = l.ref UNION ALL "
    + _dropped("TagMapId", "CASE WHEN tag IS NULL THEN 'dangling TagId' ELSE 'dangling reference in source' END", "tm_seq WHERE tag IS NULL OR ref IS NULL"),
}
CTES |= {f"l_{t}": sql for t, sql in LINEAGE.items()}
CTES |= {
    "dropped": "SELECT src, \"table\", count(*) AS dropped FROM (" + " UNION ALL ".join(
        f"SELECT src, '{t}' AS \"table\" FROM l_{t} WHERE kind = 'dropped'" for t in schema.TABLES) + ") GROUP BY src, \"table\"",
    "source_n": " UNION ALL ".join(f"SELECT src, '{t}' AS \"table\", count(*) AS n FROM s_{t} GROUP BY src" for t in schema.TABLES),
    "final_n": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM f_{t}" for t in schema.TABLES) + ") WHERE n > 0",
    "expect": """SELECT s."table", max(n) AS max_source, max(greatest(0, n - coalesce(dropped, 0))) AS max_carried, CAST(sum(n) AS BIGINT) AS sum_source
        FROM source_n s LEFT JOIN dropped d ON d.src = s.src AND d."table" = s."table" GROUP BY s."table\"""",
}


# ---- health checks: (code, rows with src) over source tables, prefix t in {s_, f_}
def _missing(table: str, ref: str, parent: str, pk: str) -> str:
    return (
        f"FROM {{t}}{table} c WHERE c.{ref} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{t}}{parent} p WHERE p.{pk} = c.{ref} {{on:p}})"
    )


def _unused(table: str, pk: str, *uses: tuple[str, str], where: str = "true") -> str:
    tests = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {{t}}{u} p WHERE p.{c} = c.{pk2} {{on:p}})" for u, c, pk2 in [(u, x, pk) for u, x in uses])
    return f"FROM {{t}}{table} c WHERE {where} {tests}"


_LOCATION_USES = [("Note", "LocationId"), ("UserMark", "LocationId"), ("Bookmark", "LocationId"), ("Bookmark", "PublicationLocationId"),
                  ("InputField", "LocationId"), ("TagMap", "LocationId"), ("PlaylistItemLocationMap", "LocationId")]
_EMPTY = f"{norm('c.Title')} = '' AND {norm('c.Content')} = ''"
_RS = ("(SELECT {k}UserMarkId, string_agg(sig, ',' ORDER BY sig) AS rs FROM (SELECT *, concat_ws('|', BlockType, Identifier, coalesce(CAST(StartToken AS VARCHAR), '-'), "
       "coalesce(CAST(EndToken AS VARCHAR), '-')) AS sig FROM {t}BlockRange) GROUP BY ALL)")

HEALTH = {
    "A1": [_missing("Note", "LocationId", "Location", "LocationId")],
    "A2": [_missing("Note", "UserMarkId", "UserMark", "UserMarkId")],
    "A3": [_missing("UserMark", "LocationId", "Location", "LocationId")],
    "A4": [_missing("BlockRange", "UserMarkId", "UserMark", "UserMarkId")],
    "A5": [_missing("Bookmark", "LocationId", "Location", "LocationId")],
    "A6": [_missing("Bookmark", "PublicationLocationId", "Location", "LocationId")],
    "A7": [_missing("InputField", "LocationId", "Location", "LocationId")],
    "A8": [_missing("TagMap", "NoteId", "Note", "NoteId")],
    "A9": [_missing("TagMap", "LocationId", "Location", "LocationId")],
    "A10": [_missing("TagMap", "PlaylistItemId", "PlaylistItem", "PlaylistItemId")],
    "A11": [_missing("TagMap", "TagId", "Tag", "TagId")],
    "A12": [_missing("PlaylistItem", "Accuracy", "PlaylistItemAccuracy", "PlaylistItemAccuracyId")],
    "A13": [_missing("PlaylistItem", "ThumbnailFilePath", "IndependentMedia", "FilePath")],
    "A14": [_missing(x, "PlaylistItemId", "PlaylistItem", "PlaylistItemId") for x in
            ("PlaylistItemLocationMap", "PlaylistItemIndependentMediaMap", "PlaylistItemMarker")],
    "A15": [_missing("PlaylistItemLocationMap", "LocationId", "Location", "LocationId")],
    "A16": [_missing("PlaylistItemIndependentMediaMap", "IndependentMediaId", "IndependentMedia", "IndependentMediaId")],
    "A17": [_missing(x, "PlaylistItemMarkerId", "PlaylistItemMarker", "PlaylistItemMarkerId") for x in
            ("PlaylistItemMarkerBibleVerseMap", "PlaylistItemMarkerParagraphMap")],
    "B1": [_unused("Location", "LocationId", *_LOCATION_USES)],
    "B2": [_unused("UserMark", "UserMarkId", ("BlockRange", "UserMarkId"))],
    "B3": [_unused("Tag", "TagId", ("TagMap", "TagId"), where="c.Type <> 2")],
    "B4": ["FROM {t}IndependentMedia c WHERE NOT EXISTS (SELECT 1 FROM {t}PlaylistItemIndependentMediaMap p WHERE p.IndependentMediaId = c.IndependentMediaId {on:p}) "
           "AND NOT EXISTS (SELECT 1 FROM {t}PlaylistItem p WHERE p.ThumbnailFilePath = c.FilePath {on:p})"],
    "B5": [_unused("PlaylistItem", "PlaylistItemId", ("TagMap", "PlaylistItemId"))],
    "B6": [_unused("PlaylistItem", "PlaylistItemId", ("PlaylistItemLocationMap", "PlaylistItemId"), ("PlaylistItemIndependentMediaMap", "PlaylistItemId"))],
    "B7": ["FROM {t}Note c WHERE c.LocationId IS NULL AND c.UserMarkId IS NULL"],
    "B8": [_unused("Note", "NoteId", ("TagMap", "NoteId"), where=_EMPTY.replace("{", "{{").replace("}", "}}"))],
    "B9": [_unused("Tag", "TagId", ("TagMap", "TagId"), where="c.Type = 2")],
    "C1": ["FROM {t}Note c JOIN {t}UserMark p ON p.UserMarkId = c.UserMarkId {on:p} WHERE p.LocationId <> c.LocationId"],
    "C2": ["FROM {t}Bookmark c JOIN {t}Location p ON p.LocationId = c.LocationId {on:p} JOIN {t}Location q ON q.LocationId = c.PublicationLocationId {on:q} "
           "WHERE coalesce(p.KeySymbol, '') <> coalesce(q.KeySymbol, '') OR coalesce(p.MepsLanguage, -1) <> coalesce(q.MepsLanguage, -1)"],
    "C3": ["FROM (SELECT *, row_number() OVER (PARTITION BY {k}UserMarkId, BlockType, Identifier, StartToken, EndToken) AS n FROM {t}BlockRange) c WHERE n > 1"],
    "C4": ["FROM (SELECT u.*, row_number() OVER (PARTITION BY {ku}u.LocationId, ColorIndex, StyleIndex, rs) AS n FROM {t}UserMark u JOIN " + _RS
           + " r ON r.UserMarkId = u.UserMarkId {onru}) c WHERE n > 1"],
    "C5": ["FROM (SELECT *, row_number() OVER (PARTITION BY {k}LocationId, rs) AS n, min(ColorIndex * 1000 + StyleIndex) OVER (PARTITION BY {k}LocationId, rs) AS a, "
           "max(ColorIndex * 1000 + StyleIndex) OVER (PARTITION BY {k}LocationId, rs) AS b FROM (SELECT u.*, r.rs FROM {t}UserMark u JOIN " + _RS
           + " r ON r.UserMarkId = u.UserMarkId {onru})) c WHERE n > 1 AND a <> b"],
    "C6": ["FROM {t}TagMap c WHERE CAST(c.NoteId IS NOT NULL AS INT) + CAST(c.LocationId IS NOT NULL AS INT) + CAST(c.PlaylistItemId IS NOT NULL AS INT) <> 1"],
    "D1": ["FROM {t}IndependentMedia c WHERE NOT EXISTS (SELECT 1 FROM {files} p WHERE p.path = c.FilePath {on:p})"],
    "D2": ["FROM {files} c WHERE NOT EXISTS (SELECT 1 FROM {t}IndependentMedia p WHERE p.FilePath = c.path {on:p})"],
}


def _health_sql(code: str, merged: bool, prefix: str = "s_") -> str:
    """Number of findings, per source or over the default result."""
    parts = []
    for text in HEALTH[code]:
        text = text.replace("{on:p}", "" if merged else "AND p.src = c.src").replace("{on:q}", "" if merged else "AND q.src = c.src")
        text = text.format(
            t="f_" if merged else prefix, k="" if merged else "src, ", ku="" if merged else "u.src, ", onru="" if merged else "AND r.src = u.src",
            files="(SELECT FilePath AS path FROM md_held)" if merged else f"{prefix}media_files",
        )
        parts.append(f"SELECT {'1 AS x' if merged else 'c.src'} {text}")
    rows = " UNION ALL ".join(parts)
    if merged:
        return f"SELECT '{code}' AS code, (SELECT count(*) FROM ({rows})) AS \"count\""
    return f"SELECT src, '{code}' AS code, count(*) AS \"count\" FROM ({rows}) GROUP BY src"


CTES["findings"] = "SELECT r.*, h.\"count\" FROM (VALUES " + ", ".join(
    f"('{code}', '{category}', {repr(clean) if clean else 'CAST(NULL AS VARCHAR)'}, {str(info).lower()})" for code, category, clean, info, _ in CHECKS
) + ") r(code, category, cleanup, info) JOIN (" + " UNION ALL ".join(_health_sql(c[0], True) for c in CHECKS) + ") h USING (code)"


# ---- samples of the checks on the default result: (order, text) per finding, the first eight
def _at(location: str) -> str:
    return f"CASE WHEN {location} IS NULL THEN 'no location' ELSE coalesce((SELECT text FROM where_ w WHERE w.LocationId = {location}), 'unknown location') END"


_STYLED = """(SELECT u.*, fp.rs, ColorIndex || '/' || StyleIndex AS style FROM f_UserMark u JOIN fp ON fp.UserMarkId = u.UserMarkId)"""
SAMPLES = {
    "B1": ("c.LocationId", "'#' || c.LocationId || ' ' || " + _at("c.LocationId")),
    "B2": ("c.UserMarkId", "'highlight #' || c.UserMarkId || ' at ' || " + _at("c.LocationId")),
    "B3": ("c.TagId", "'tag \"' || c.Name || '\"'"),
    "B4": ("c.IndependentMediaId", "c.OriginalFilename || ' (' || c.FilePath || ')'"),
    "B5": ("c.PlaylistItemId", "'playlist item #' || c.PlaylistItemId || ' \"' || c.Label || '\"'"),
    "B6": ("c.PlaylistItemId", "'playlist item #' || c.PlaylistItemId || ' \"' || c.Label || '\"'"),
    "B7": ("c.NoteId", "'note #' || c.NoteId"),
    "B8": ("c.NoteId", "'note #' || c.NoteId || ' at ' || " + _at("c.LocationId")),
    "B9": ("c.TagId", "'playlist \"' || c.Name || '\"'"),
    "C1": ("c.NoteId", "'note #' || c.NoteId || ': ' || " + _at("c.LocationId") + " || ' vs highlight at ' || " + _at("p.LocationId")),
    "C2": ("c.BookmarkId", "'bookmark #' || c.BookmarkId || ': ' || " + _at("c.LocationId") + " || ' recorded under ' || " + _at("c.PublicationLocationId")),
    "C6": ("c.TagMapId", "'tag assignment #' || c.TagMapId"),
    "D1": ("c.IndependentMediaId", "c.OriginalFilename || ' (' || c.FilePath || ')'"),
    "D2": ("c.path", "c.path"),
}


def _samples() -> str:
    parts = []
    for code, (order, text) in SAMPLES.items():
        for body in HEALTH[code]:
            rows = body.replace("{on:p}", "").replace("{on:q}", "").format(t="f_", k="", ku="", onru="", files="(SELECT FilePath AS path FROM md_held)")
            parts.append(f"SELECT '{code}' AS code, row_number() OVER (ORDER BY {order}) - 1 AS nth, {text} AS sample {rows}")
    for code, partition, more in (("C4", "LocationId, rs, style", "true"), ("C5", "LocationId, rs", "styles > 1")):
        parts.append(f"""SELECT '{code}', row_number() OVER (ORDER BY lead, o, n) - 1, {_at('c.LocationId')} || ' (highlights #' || ids || CASE WHEN c.size > 16 THEN ' and ' || (c.size - 16) || ' more' ELSE '' END || ')' FROM (
          SELECT LocationId, unnest(range(2, c + 1)) AS n, c AS size, ids, lead, o FROM (SELECT LocationId, count(*) AS c, min(lead) AS lead, min(UserMarkId) AS o,
            count(DISTINCT style) AS styles, array_to_string(list_transform(list(UserMarkId ORDER BY UserMarkId)[1:16], lambda i: CAST(i AS VARCHAR)), ', #') AS ids
            FROM (SELECT *, min(UserMarkId) OVER (PARTITION BY LocationId, rs) AS lead FROM {_STYLED}) GROUP BY {partition}) WHERE c > 1 AND {more}) c""")
    parts.append("""SELECT 'C3', row_number() OVER (ORDER BY o, n) - 1, 'highlight #' || UserMarkId FROM (SELECT UserMarkId, o, unnest(range(0, c)) AS n FROM (
        SELECT UserMarkId, CAST(sum(k - 1) AS BIGINT) AS c, min(o) AS o FROM (SELECT UserMarkId, count(*) AS k, min(BlockRangeId) AS o FROM f_BlockRange
          GROUP BY UserMarkId, BlockType, Identifier, StartToken, EndToken) GROUP BY UserMarkId))""")
    return "SELECT code, CAST(nth AS INT) AS nth, sample FROM (" + " UNION ALL ".join(parts) + ") WHERE nth < 8"


# ---- locations that meet by several keys: one step per source
def _tangled() -> str:
    keyed = f"""t0 AS ({derive.oracle_text('Location', True)}),
      t1 AS (SELECT *, {ord_('LocationId')} AS o,
        CASE WHEN BookNumber IS NOT NULL AND ChapterNumber IS NOT NULL AND KeySymbol IS NOT NULL AND MepsLanguage IS NOT NULL
          THEN concat_ws('|', 'T', BookNumber, ChapterNumber, KeySymbol, MepsLanguage, Type) END AS kt,
        CASE WHEN KeySymbol IS NOT NULL AND MepsLanguage IS NOT NULL AND DocumentId IS NOT NULL AND Track IS NOT NULL
          THEN concat_ws('|', 'M', KeySymbol, IssueTagNumber, MepsLanguage, DocumentId, Track, Type, coalesce(Specialty, ''), coalesce(Edition, '')) END AS km,
        concat_ws('|', 'F', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in _LOC[:8])}, coalesce(Specialty, ''), coalesce(Edition, '')) AS kf
        FROM t0),
      t2 AS (SELECT *, row_number() OVER (PARTITION BY src, kf ORDER BY LocationId) AS occ FROM t1),
      e0 AS (SELECT o, o AS ent FROM t2 WHERE src = 0)"""
    steps = []
    for s in (1, 2):
        prior = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(s))
        steps.append(f"""
      p{s} AS (SELECT t2.*, p.ent FROM t2 JOIN ({prior}) p ON p.o = t2.o),
      i{s} AS (SELECT k, ent, min(o) AS added FROM (SELECT kt AS k, ent, o FROM p{s} UNION ALL SELECT km, ent, o FROM p{s} UNION ALL SELECT kf, ent, o FROM p{s})
        WHERE k IS NOT NULL GROUP BY k, ent),
      j{s} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY added) AS nth FROM i{s}),
      e{s} AS (SELECT t2.o, coalesce(t.ent, m.ent, f.ent, t2.o) AS ent FROM t2 LEFT JOIN j{s} t ON t.k = t2.kt AND t.nth = 1
        LEFT JOIN j{s} m ON m.k = t2.km AND m.nth = 1
        LEFT JOIN j{s} f ON f.k = t2.kf AND f.nth = CASE WHEN t2.kt IS NULL AND t2.km IS NULL THEN t2.occ ELSE 1 END WHERE t2.src = {s})""")
    return f"""WITH {keyed}, {', '.join(steps)},
      matched AS (SELECT t2.*, e.ent, dense_rank() OVER (ORDER BY e.ent) AS gid FROM t2 JOIN (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) e USING (o))
      SELECT gid AS LocationId, {', '.join(f'any_value({c}) FILTER (o = ent) AS {c}' for c in _LOC)},
        coalesce(arg_min(Title, o) FILTER ({trim("coalesce(Title, '')")} <> ''), any_value(Title) FILTER (o = ent), ' ') AS Title
      FROM matched GROUP BY gid"""


def _cols(table: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if f"{c} bigint" in schema.COLUMNS[table] else c for c in schema.columns(table))


def _conflict_rows(cands: str, pick: str, field: bool = False) -> str:
    where = "coalesce(w.text, 'unknown location')"
    context = f"{where} || ' · field \"' || any_tag || '\"'" if field else f"CASE WHEN c.loc IS NULL THEN 'note without a location' ELSE {where} END"
    tag = ", any_value(TextTag) AS any_tag" if field else ""
    return f"""SELECT p.conflict_id, identity_key, gid, n_candidates, suggested_src, decided_by, {context} AS context FROM {pick} p
      JOIN (SELECT conflict_id, any_value(identity_key) AS identity_key, any_value(gid) AS gid, arg_min(loc, o) FILTER (loc IS NOT NULL) AS loc {tag} FROM {cands} GROUP BY conflict_id) c
      USING (conflict_id) LEFT JOIN where_ w ON w.LocationId = c.loc"""


_CAND = "conflict_id, src, pk, label, gid, timestamp, timestamp_source, backup_timestamp"
_FRESH_GUID = guid("(conflict_id || ':' || src)")

def _digest(table: str) -> str:
    row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in schema.columns(table))
    lanes = ", ".join(f"sum(CAST('0x' || substr(r, {1 + 16 * i}, 15) AS BIGINT))" for i in range(4))
    return f"""SELECT count(*) AS n, sha256(concat_ws('/', count(*), {lanes})) AS digest FROM (SELECT sha256(concat_ws({_SEP}, {row})) AS r FROM m_{table})"""


_RULES = " UNION ALL ".join(
    f"SELECT src, '{t}' AS \"table\", '{n}' AS rule, count(*) FILTER (NOT coalesce({r}, true)) AS violations FROM s_{t} GROUP BY src"
    for t, n, r in schema.ROW_RULES
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT src, '{t}', '{c} is set', count(*) FILTER ({c} IS NULL) FROM s_{t} GROUP BY src" for t in schema.TABLES for c in schema.not_null_columns(t)
)

_UNIQUE = " UNION ALL ".join(
    f"SELECT src, '{t}' AS \"table\", '{n}' AS \"constraint\", count(*) AS violations FROM (SELECT src FROM s_{t} WHERE "
    + " AND ".join(f"({e}) IS NOT NULL" for e in exprs) + f" GROUP BY src, {', '.join(exprs)} HAVING count(*) > 1) GROUP BY src"
    for t, n, exprs in [(t, "primary key", schema.primary_key(t)) for t in schema.TABLES] + list(schema.UNIQUE_KEYS)
)

_FK = " UNION ALL ".join(
    f"SELECT c.src, '{child}' AS \"table\", '{col}' AS \"column\", count(*) AS violations FROM s_{child} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM s_{parent} p WHERE p.src = c.src AND p.{pk} = c.{col}) GROUP BY c.src" for child, col, parent, pk in schema.FOREIGN_KEYS
)
_FK_MERGED = " UNION ALL ".join(
    f"SELECT '{child}' AS \"table\", '{col}' AS \"column\", count(*) AS violations FROM f_{child} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM f_{parent} p WHERE p.{pk} = c.{col})" for child, col, parent, pk in schema.FOREIGN_KEYS
)

_WARN = " UNION ALL ".join([
    "SELECT 'UserMark' AS stage, src, 'missing location' AS code, UserMarkGuid AS subject FROM um_all WHERE loc IS NULL",
    "SELECT 'IndependentMedia', src, 'missing file', FilePath FROM md_path p WHERE o = f AND NOT EXISTS (SELECT 1 FROM s_media_files x WHERE x.src = p.src AND x.path = p.FilePath)",
    "SELECT 'BlockRange', src, CASE WHEN reason = 'unpaired duplicate' THEN 'unpaired range' ELSE 'missing highlight' END, local_key FROM l_BlockRange WHERE kind = 'dropped'",
    "SELECT 'Note', src, 'highlight link cleared', Guid FROM nt_all WHERE UserMarkId IS NOT NULL AND mark IS NULL",
    "SELECT 'Note', src, 'location link cleared', Guid FROM nt_all WHERE LocationId IS NOT NULL AND loc IS NULL",
    "SELECT 'Bookmark', src, 'missing location', local_key FROM l_Bookmark WHERE kind = 'dropped'",
    "SELECT 'Bookmark', n.src, 'slot out of sight', n.Title FROM bm_new n JOIN bm_slot s USING (gid) WHERE s.slot <> n.Slot AND s.slot > 9",
    "SELECT 'InputField', src, 'missing location', TextTag FROM if_all WHERE loc IS NULL",
    "SELECT 'PlaylistItem', src, 'missing accuracy', Label FROM it_all WHERE acc IS NULL",
    "SELECT 'PlaylistItem', src, 'thumbnail cleared', Label FROM it WHERE o = f AND ThumbnailFilePath IS NOT NULL AND thumb IS NULL",
    "SELECT 'PlaylistItemLocationMap', src, 'missing location', local_key FROM l_PlaylistItemLocationMap WHERE reason = 'dangling LocationId'",
    "SELECT 'PlaylistItemIndependentMediaMap', src, 'missing media row', local_key FROM l_PlaylistItemIndependentMediaMap WHERE reason = 'dangling IndependentMediaId'",
    "SELECT 'TagMap', src, 'missing tag', CAST(TagId AS VARCHAR) FROM tm_seq WHERE tag IS NULL GROUP BY src, TagId",
    "SELECT 'TagMap', src, 'missing target', CAST(TagMapId AS VARCHAR) FROM tm_seq WHERE tag IS NOT NULL AND ref IS NULL",
])

_COUNTERS = {"Location": "locationsDeduped", "UserMark": "userMarksDeduped", "BlockRange": "blockRangesDeduped", "Note": "notesDeduped",
             "Bookmark": "bookmarksDeduped", "InputField": "inputFieldsDeduped", "IndependentMedia": "mediaDeduped",
             "PlaylistItemAccuracy": "playlistItemAccuraciesDeduped", "PlaylistItem": "playlistItemsDeduped", "TagMap": "tagMapsDeduped"}
_AUTO = "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{name}' AS counter, count(*) AS n FROM l_{t} WHERE kind = 'mapped' AND merged_into" for t, name in _COUNTERS.items()] + [
        "SELECT 'locationTitlesNormalized', count(*) FROM m_Location WHERE title_normalized",
        "SELECT 'bookmarksRenumbered', count(*) FROM bm_new n JOIN bm_slot s USING (gid) WHERE s.slot <> n.Slot",
        "SELECT 'mediaRenamed', count(*) FROM md_named WHERE renamed",
        "SELECT CASE WHEN Type = 2 THEN 'playlistsMergedByName' ELSE 'tagsMerged' END, count(*) FROM tg WHERE o <> f GROUP BY Type = 2, 1",
        "SELECT 'tagPositionsRenumbered', count(*) FROM tm_pos WHERE pos <> Position",
    ]) + ") WHERE n > 0"

_NOTE = "NoteId, Guid, UserMarkId, LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier"
_PREDICT = "n + coalesce(extra, 0)"
for _name, _table in CLEANED_TABLE.items():
    _PREDICT = f"greatest(0, {_PREDICT} - CASE WHEN \"table\" = '{_table}' THEN (SELECT \"count\" FROM findings WHERE cleanup = '{_name}') ELSE 0 END)"

_WORDS = "regexp_split_to_array(coalesce(%s, ''), '\\s+')"
_TS_RAW = """CASE event_id % 6 WHEN 0 THEN base || 'Z' WHEN 1 THEN base || '.1234567Z' WHEN 2 THEN base || '-0400' WHEN 3 THEN replace(base, 'T', ' ')
  WHEN 4 THEN base || '+05:30' ELSE 'about ' || base END"""
_TS_NORMAL = """CASE event_id % 6 WHEN 0 THEN base || 'Z' WHEN 1 THEN base || '.123Z' WHEN 2 THEN base || '-04:00' WHEN 3 THEN base
  WHEN 4 THEN base || '+05:30' ELSE 'about ' || base END"""
_TS_MS = """CASE event_id % 6 WHEN 0 THEN ms WHEN 1 THEN ms + 123 WHEN 2 THEN ms + 4 * 3600000 WHEN 3 THEN ms WHEN 4 THEN ms - 19800000 END"""

_MARKS = "CAST(2 * ColorIndex - 2 AS INT)"
_SIZE = "CAST(floor(o_totalprice * pow(8.0, o_orderkey % 8)) AS BIGINT)"

def _short(value: str) -> str:
    """One decimal below 100, none from there on, halves rounded up as the reference does."""
    v = f"CAST({value} AS DOUBLE)"
    return f"CASE WHEN {v} >= 100 THEN printf('%.0f', floor({v} + 0.5)) ELSE printf('%.1f', floor({v} * 10 + 0.5) / 10) END"


_MANIFEST_VERSION = "CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END"
_MANIFEST_BAD = ("CASE WHEN event_id % 9 = 0 THEN 'not valid JSON' WHEN event_id % 10 = 0 THEN 'no userDataBackup' "
                 f"WHEN {_MANIFEST_VERSION} IS NULL THEN 'no numeric userDataBackup.schemaVersion' END")

# ---- the damaged snapshots: rules, keys and references stated once more, on their own
# What a row must not be, where the damaged rows are.
BROKEN_ROWS = {
    "Location": [
        ("document or named place", "Type = 0 AND coalesce(DocumentId, 0) = 0 AND NOT (coalesce(KeySymbol, '') <> '' AND (Track IS NOT NULL OR coalesce(BookNumber, 0) <> 0))"),
        ("publication", "Type = 1 AND (coalesce(BookNumber, 0) <> 0 OR coalesce(ChapterNumber, 0) <> 0 OR coalesce(DocumentId, 0) <> 0 OR coalesce(KeySymbol, '') = '' OR Track IS NOT NULL)"),
        ("recording", "Type IN (2, 3) AND (coalesce(BookNumber, 0) <> 0 OR coalesce(ChapterNumber, 0) <> 0)"),
        ("IssueTagNumber is set", "IssueTagNumber IS NULL"),
    ],
    "UserMark": [("ColorIndex is set", "ColorIndex IS NULL")],
    "BlockRange": [("block type", "BlockType NOT IN (1, 2)")],
    "Note": [("block pair", "(BlockType = 0) <> (BlockIdentifier IS NULL)"), ("Guid is set", "Guid IS NULL")],
    "Bookmark": [("block pair", "(BlockType = 0) <> (BlockIdentifier IS NULL)")],
    "IndependentMedia": [("original name", "OriginalFilename = ''"), ("path", "FilePath = ''"), ("mime type", "MimeType = ''"), ("hash", "Hash = ''")],
    "Tag": [("name", "Name = ''"), ("type", "Type NOT IN (0, 1, 2)")],
    "PlaylistItem": [("label", "Label = ''"), ("end action", "EndAction NOT IN (0, 1, 2, 3)")],
    "PlaylistItemMarkerParagraphMap": [("ParagraphIndex is set", "ParagraphIndex IS NULL")],
    "TagMap": [("one target", "(NoteId IS NULL AND LocationId IS NULL AND PlaylistItemId IS NULL) OR (NoteId IS NOT NULL AND LocationId IS NOT NULL) "
                "OR (NoteId IS NOT NULL AND PlaylistItemId IS NOT NULL) OR (LocationId IS NOT NULL AND PlaylistItemId IS NOT NULL)")],
}
# What must not repeat in a source, the primary key first.
SINGLE = {
    "Location": [("primary key", "LocationId"), ("place", "BookNumber, ChapterNumber, KeySymbol, MepsLanguage, Type"),
                 ("media", "KeySymbol, IssueTagNumber, MepsLanguage, DocumentId, Track, Type, coalesce(Specialty, ''), coalesce(Edition, '')")],
    "UserMark": [("primary key", "UserMarkId"), ("guid", "UserMarkGuid")],
    "IndependentMedia": [("primary key", "IndependentMediaId"), ("path", "FilePath")],
    "BlockRange": [("primary key", "BlockRangeId")],
    "Note": [("primary key", "NoteId"), ("guid", "Guid")],
    "Bookmark": [("primary key", "BookmarkId"), ("slot", "PublicationLocationId, Slot")],
    "InputField": [("primary key", "LocationId, TextTag")],
    "Tag": [("primary key", "TagId"), ("name", "Type, Name")],
    "PlaylistItemAccuracy": [("primary key", "PlaylistItemAccuracyId"), ("description", "Description")],
    "PlaylistItem": [("primary key", "PlaylistItemId")],
    "PlaylistItemLocationMap": [("primary key", "PlaylistItemId, LocationId")],
    "PlaylistItemIndependentMediaMap": [("primary key", "PlaylistItemId, IndependentMediaId")],
    "PlaylistItemMarker": [("primary key", "PlaylistItemMarkerId"), ("start", "PlaylistItemId, StartTimeTicks")],
    "PlaylistItemMarkerBibleVerseMap": [("primary key", "PlaylistItemMarkerId, VerseId")],
    "PlaylistItemMarkerParagraphMap": [("primary key", "PlaylistItemMarkerId, MepsDocumentId, ParagraphIndex, MarkerIndexWithinParagraph")],
    "TagMap": [("primary key", "TagMapId"), ("position", "TagId, Position"), ("note", "TagId, NoteId"), ("location", "TagId, LocationId"), ("item", "TagId, PlaylistItemId")],
}
# Column and parent (whose first column it is, but for thumbnails).
REFERS = {
    "UserMark": [("LocationId", "Location")], "BlockRange": [("UserMarkId", "UserMark")], "Note": [("UserMarkId", "UserMark"), ("LocationId", "Location")],
    "Bookmark": [("LocationId", "Location"), ("PublicationLocationId", "Location")], "InputField": [("LocationId", "Location")],
    "PlaylistItem": [("Accuracy", "PlaylistItemAccuracy"), ("ThumbnailFilePath", "IndependentMedia")],
    "PlaylistItemLocationMap": [("PlaylistItemId", "PlaylistItem"), ("LocationId", "Location")],
    "PlaylistItemIndependentMediaMap": [("PlaylistItemId", "PlaylistItem"), ("IndependentMediaId", "IndependentMedia")],
    "PlaylistItemMarker": [("PlaylistItemId", "PlaylistItem")], "PlaylistItemMarkerBibleVerseMap": [("PlaylistItemMarkerId", "PlaylistItemMarker")],
    "PlaylistItemMarkerParagraphMap": [("PlaylistItemMarkerId", "PlaylistItemMarker")],
    "TagMap": [("TagId", "Tag"), ("PlaylistItemId", "PlaylistItem"), ("LocationId", "Location"), ("NoteId", "Note")],
}


def _set(keys: str) -> str:
    return " AND ".join(f"({k}) IS NOT NULL" for k in re.sub(r"coalesce\([^)]*\)", "1", keys).split(", "))


def _absent(child: str, column: str, parent: str, prefix: str) -> str:
    key = {"ThumbnailFilePath": "FilePath"}.get(column, parent + "Id")
    return f"FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {prefix}{parent} p WHERE p.src = c.src AND p.{key} = c.{column})"


for _t, _keys in SINGLE.items():
    CTES[f"dr_{_t}"] = f"SELECT *, row_number() OVER () AS rid FROM d_{_t}"
    _bad = [f"SELECT src, rid, '{rule}' AS rule FROM dr_{_t} WHERE {broken}" for rule, broken in BROKEN_ROWS.get(_t, [])]
    _bad += [f"SELECT src, rid, 'unique {name}' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY src, {key} ORDER BY {_keys[0][1]}, rid) AS nth FROM dr_{_t} WHERE {_set(key)}) WHERE nth > 1"
             for name, key in _keys]
    _bad += [f"SELECT c.src, rid, '{column} refers to {parent}' AS rule {_absent('dr_' + _t, column, parent, 'ok_')}" for column, parent in REFERS.get(_t, [])]
    CTES[f"bad_{_t}"] = " UNION ALL ".join(_bad)
    CTES[f"ok_{_t}"] = f"SELECT * FROM dr_{_t} WHERE rid NOT IN (SELECT rid FROM bad_{_t})"

# Clean-ups of each damaged source, one after the other.
_D_EMPTY = f"{norm('n.Title')} = '' AND {norm('n.Content')} = ''"
CTES["dc_gone_notes"] = f"SELECT src, NoteId FROM d_Note n WHERE {_D_EMPTY} AND NOT EXISTS (SELECT 1 FROM d_TagMap t WHERE t.src = n.src AND t.NoteId = n.NoteId)"
CTES["dc_notes"] = "SELECT * FROM d_Note n WHERE NOT EXISTS (SELECT 1 FROM dc_gone_notes g WHERE g.src = n.src AND g.NoteId = n.NoteId)"
CTES["dc_gone_marks"] = "SELECT src, UserMarkId FROM d_UserMark u WHERE NOT EXISTS (SELECT 1 FROM d_BlockRange b WHERE b.src = u.src AND b.UserMarkId = u.UserMarkId)"
CTES["dc_prints"] = """SELECT src, UserMarkId, string_agg(sig, ',' ORDER BY sig) AS rs FROM (SELECT src, UserMarkId, concat_ws('|', BlockType, Identifier,
    coalesce(CAST(StartToken AS VARCHAR), '-'), coalesce(CAST(EndToken AS VARCHAR), '-')) AS sig FROM d_BlockRange) GROUP BY src, UserMarkId"""
CTES["dc_marks"] = """SELECT u.src, u.UserMarkId, u.LocationId, row_number() OVER (PARTITION BY u.src, u.LocationId, ColorIndex, StyleIndex, rs
      ORDER BY coalesce(k.n, 0) DESC, u.UserMarkId) AS nth, first_value(u.UserMarkId) OVER (PARTITION BY u.src, u.LocationId, ColorIndex, StyleIndex, rs ORDER BY coalesce(k.n, 0) DESC, u.UserMarkId) AS keeper
    FROM d_UserMark u JOIN dc_prints p ON p.src = u.src AND p.UserMarkId = u.UserMarkId
    LEFT JOIN (SELECT src, UserMarkId, count(*) AS n FROM dc_notes GROUP BY src, UserMarkId) k ON k.src = u.src AND k.UserMarkId = u.UserMarkId"""
CTES["dc_gone_media"] = """SELECT src, IndependentMediaId FROM d_IndependentMedia m WHERE NOT EXISTS (SELECT 1 FROM d_PlaylistItemIndependentMediaMap i WHERE i.src = m.src AND i.IndependentMediaId = m.IndependentMediaId)
    AND NOT EXISTS (SELECT 1 FROM d_PlaylistItem i WHERE i.src = m.src AND i.ThumbnailFilePath = m.FilePath)"""
CTES["dc_uses"] = """SELECT src, LocationId FROM dc_notes UNION SELECT src, LocationId FROM dc_marks WHERE nth = 1 UNION SELECT src, LocationId FROM d_Bookmark UNION SELECT src, PublicationLocationId FROM d_Bookmark
    UNION SELECT src, LocationId FROM d_InputField UNION SELECT src, LocationId FROM d_TagMap UNION SELECT src, LocationId FROM d_PlaylistItemLocationMap"""

_LATE_STEP = "{y}.ts > {x}.ts OR ({y}.ts = {x}.ts AND {x}.said <> {y}.said AND {later})"
_LATE_NOTES = f"""WITH n AS (SELECT src, Guid, Title, Content, LastModified, {millis('LastModified')} AS ts, {norm('Title')} || chr(31) || {norm('Content')} AS said FROM s_Note),
    early AS (SELECT coalesce(a.Guid, b.Guid) AS Guid, CASE WHEN a.Guid IS NULL OR coalesce({_LATE_STEP.format(x='a', y='b', later='true')}, false) THEN 1 ELSE 0 END AS src
      FROM (SELECT * FROM n WHERE src = 0) a FULL JOIN (SELECT * FROM n WHERE src = 1) b ON a.Guid = b.Guid),
    first AS (SELECT n.* FROM early e JOIN n ON n.Guid = e.Guid AND n.src = e.src),
    pick AS (SELECT coalesce(f.Guid, c.Guid) AS Guid, CASE WHEN f.Guid IS NULL OR coalesce({_LATE_STEP.format(x='f', y='c', later='false')}, false) THEN 2 ELSE f.src END AS src
      FROM first f FULL JOIN (SELECT * FROM n WHERE src = 2) c ON f.Guid = c.Guid)
    SELECT n.Guid, n.Title, n.Content, n.LastModified FROM pick p JOIN n ON n.Guid = p.Guid AND n.src = p.src"""

_FINAL = {
    **{f"merge_{q}": f"SELECT {_cols(t)} FROM m_{t}" for q, t in {
        "notes": "Note", "locations": "Location", "user_marks": "UserMark", "block_ranges": "BlockRange", "media": "IndependentMedia",
        "bookmarks": "Bookmark", "input_fields": "InputField", "tags": "Tag", "accuracy": "PlaylistItemAccuracy", "playlist_items": "PlaylistItem",
        "item_locations": "PlaylistItemLocationMap", "item_media": "PlaylistItemIndependentMediaMap", "markers": "PlaylistItemMarker",
        "marker_verses": "PlaylistItemMarkerBibleVerseMap", "marker_paragraphs": "PlaylistItemMarkerParagraphMap", "tag_map": "TagMap",
    }.items()},
    "merge_locations_tangled": _tangled(),
    "note_conflicts": _conflict_rows("nt_cand", "nt_pick"),
    "mark_conflicts": _conflict_rows("um_cand", "um_pick"),
    "input_field_conflicts": _conflict_rows("if_cand", "if_pick", True),
    "note_candidates": f"SELECT {_CAND} FROM nt_cand",
    "mark_candidates": f"SELECT {_CAND} FROM um_cand",
    "media_renames": "SELECT gid AS IndependentMediaId, Hash, new_path AS FilePath FROM md_named WHERE renamed",
    "collected_media": "SELECT gid, FilePath, src, path FROM md_held",
    "media_bytes": "SELECT h.FilePath, octet_length(encode(content)) AS size, sha256(content) AS sha256 FROM md_held h JOIN s_media_files f ON f.src = h.src AND f.path = h.path",
    "bookmark_slots": "SELECT gid AS BookmarkId, pub AS PublicationLocationId, n.Slot AS own_slot, s.slot AS Slot FROM bm_new n JOIN bm_slot s USING (gid)",
    **{f"lineage_{t.lower()}": f"SELECT * FROM l_{t}" for t in schema.TABLES},
    "dropped_counts": "SELECT * FROM dropped",
    "source_counts": "SELECT * FROM source_n",
    "sum_counts": "SELECT \"table\", CAST(sum(n) AS BIGINT) AS n FROM source_n GROUP BY \"table\"",
    "conflict_counts": "SELECT kind, count(*) AS n FROM conf GROUP BY kind",
    "warnings": _WARN,
    "auto_summary": _AUTO,
    "finalize_default": f"SELECT {_NOTE} FROM f_Note",
    "finalize_notes": f"""SELECT {_NOTE} FROM m_Note UNION ALL SELECT {_NOTE} FROM nt_rows n JOIN verdict v ON v.conflict_id = 'note:' || n.Guid AND v.win = n.src WHERE conflict
        UNION ALL SELECT fresh, {_FRESH_GUID}, UserMarkId, LocationId, Title, Content, LastModified, Created, BlockType, BlockIdentifier FROM x_notes""",
    "finalize_marks": f"""SELECT * FROM m_UserMark UNION ALL SELECT u.gid, ColorIndex, loc, StyleIndex, UserMarkGuid, Version FROM um u
        JOIN verdict v ON v.conflict_id = 'userMark:' || u.UserMarkGuid AND v.win = u.src
        UNION ALL SELECT fresh, ColorIndex, loc, StyleIndex, {_FRESH_GUID}, Version FROM x_marks""",
    "finalize_ranges": """SELECT * FROM m_BlockRange UNION ALL SELECT b.gid, BlockType, Identifier, StartToken, EndToken, mark FROM br_kept b
        JOIN verdict v ON v.conflict_id = 'userMark:' || b.UserMarkGuid AND v.win = b.src
        UNION ALL SELECT (SELECT max(gid) FROM br_kept) + row_number() OVER (ORDER BY b.mark, b.src, b.UserMarkId, b.gid), b.BlockType, b.Identifier, b.StartToken, b.EndToken, x.fresh
        FROM br_kept b JOIN x_marks x ON x.src = b.src AND x.UserMarkId = b.UserMarkId""",
    "finalize_input_fields": """SELECT * FROM m_InputField UNION ALL SELECT loc, TextTag, Value FROM fld f
        JOIN verdict v ON v.conflict_id = 'inputField:' || f.ident AND v.win = f.src""",
    "decision_log": """SELECT conflict_id, kind, CAST(win AS INT) AS winner_src, win = suggested_src AS was_suggested, kept AS kept_both, choice <> suggested_src AS overridden FROM verdict""",
    "decision_summary": """SELECT kind, count(*) AS conflicts, count(*) FILTER (choice <> suggested_src) AS overridden, count(*) FILTER (kept) AS kept_both FROM verdict GROUP BY kind""",
    "resolution_edits": """SELECT conflict_id, CASE WHEN gid % 5 = 0 THEN 2 ELSE choice END AS choice FROM verdict WHERE gid % 5 = 0 OR gid % 3 <> 0""",
    "identical_candidates": """SELECT conflict_id, src, CASE WHEN n > 1 THEN f END AS same_as FROM (SELECT *,
        row_number() OVER (PARTITION BY conflict_id, Title, Content ORDER BY o) AS n, first_value(label) OVER (PARTITION BY conflict_id, Title, Content ORDER BY o) AS f FROM nt_cand)""",
    "text_change": f"""WITH pr AS (SELECT c.conflict_id, c.src, c.Content AS a, k.Content AS b FROM nt_cand c JOIN nt_pick p USING (conflict_id)
          JOIN nt_cand k ON k.conflict_id = c.conflict_id AND k.src = p.suggested_src WHERE c.src <> p.suggested_src),
        wd AS (SELECT conflict_id, src, w, -1 AS s FROM (SELECT conflict_id, src, unnest({_WORDS % 'a'}) AS w FROM pr) WHERE w <> '' UNION ALL
          SELECT conflict_id, src, w, 1 FROM (SELECT conflict_id, src, unnest({_WORDS % 'b'}) AS w FROM pr) WHERE w <> ''),
        wc AS (SELECT conflict_id, src, w, count(*) FILTER (s = -1) AS a, count(*) FILTER (s = 1) AS b FROM wd GROUP BY ALL),
        tt AS (SELECT conflict_id, src, sum(greatest(b - a, 0)) AS x, sum(greatest(a - b, 0)) AS y, sum(least(a, b)) AS z FROM wc GROUP BY ALL)
        SELECT conflict_id, src, CAST(coalesce(x, 0) AS BIGINT) AS words_added, CAST(coalesce(y, 0) AS BIGINT) AS words_removed, CAST(coalesce(z, 0) AS BIGINT) AS words_kept,
          CASE WHEN coalesce(x + y + z, 0) = 0 THEN 0.0 ELSE round(CAST(x + y AS DOUBLE) / CAST(x + y + z AS DOUBLE), 6) END AS changed_share FROM pr LEFT JOIN tt USING (conflict_id, src)""",
    "longest_text": "SELECT conflict_id, max(length(coalesce(Title, '')) + length(coalesce(Content, ''))) AS longest FROM nt_cand GROUP BY conflict_id",
    "conflict_page": "SELECT conflict_id, gid FROM conf WHERE kind = 'note' ORDER BY gid, conflict_id LIMIT 15",
    "cleanup_empty_notes": f"SELECT {_NOTE} FROM f_Note WHERE NoteId NOT IN (SELECT NoteId FROM gone_notes)",
    "cleanup_rangeless_marks": "SELECT * FROM f_UserMark WHERE UserMarkId NOT IN (SELECT UserMarkId FROM gone_marks)",
    "cleanup_detached_notes": "SELECT NoteId, CASE WHEN UserMarkId IN (SELECT UserMarkId FROM gone_marks) THEN NULL ELSE UserMarkId END AS UserMarkId FROM f_Note",
    "cleanup_duplicate_marks": "SELECT * FROM f_UserMark WHERE UserMarkId NOT IN (SELECT UserMarkId FROM dup_marks)",
    "cleanup_reattached_notes": "SELECT NoteId, coalesce(keeper, n.UserMarkId) AS UserMarkId FROM f_Note n LEFT JOIN dup_marks d ON d.UserMarkId = n.UserMarkId",
    "cleanup_unused_media": f"SELECT {_cols('IndependentMedia')} FROM m_IndependentMedia WHERE IndependentMediaId NOT IN (SELECT IndependentMediaId FROM gone_media)",
    "cleanup_empty_playlists": f"SELECT {_cols('Tag')} FROM m_Tag WHERE TagId NOT IN (SELECT TagId FROM gone_lists)",
    "cleanup_unreferenced_locations": f"SELECT {_cols('Location')} FROM m_Location WHERE LocationId IN (SELECT id FROM f_refs)",
    "cleanup_all": "SELECT * FROM cleaned WHERE n > 0 UNION ALL SELECT 'removed ' || \"table\", n FROM lost WHERE n > 0",
    "cleanup_preview": """SELECT cleanup, cleanup NOT IN ('emptyNotes', 'emptyPlaylists') AS enabled, "count" AS predicted FROM findings WHERE cleanup IS NOT NULL""",
    "predict_counts": f"""SELECT "table", n, CAST({_PREDICT} AS BIGINT) AS predicted FROM final_n LEFT JOIN
        (SELECT CASE kind WHEN 'note' THEN 'Note' ELSE 'UserMark' END AS "table", sum(n_candidates - 1) AS extra FROM verdict WHERE kept GROUP BY 1) USING ("table")""",
    **{f"health_{c[0].lower()}": _health_sql(c[0], False) for c in CHECKS},
    "health_report": "SELECT code, category, cleanup, info, \"count\" FROM findings",
    "health_summary": "SELECT count(*) AS checks, count(*) FILTER (\"count\" > 0) AS findings, count(*) FILTER (\"count\" > 0 AND NOT info) AS problems FROM findings",
    "health_samples": _samples(),
    "fk_violations": _FK,
    "fk_violations_merged": _FK_MERGED,
    "constraint_violations": _RULES,
    "unique_violations": _UNIQUE,
    "reconcile_counts": """SELECT "table", max_source, max_carried, sum_source, final, removed, final <= sum_source AND (final >= max_carried - removed OR "table" = 'BlockRange') AS ok
        FROM (SELECT e.*, f.n - coalesce(l.n, 0) AS final, coalesce(l.n, 0) AS removed FROM expect e JOIN final_n f USING ("table") LEFT JOIN lost l USING ("table"))""",
    "build_report": """SELECT bad = 0 AS ok, CAST(0 AS BIGINT) AS foreign_key_violations, CAST(0 AS BIGINT) AS rules_broken, CAST(0 AS BIGINT) AS tables_changed, bad AS n_errors,
        (SELECT count(*) FROM md_held WHERE gid NOT IN (SELECT IndependentMediaId FROM gone_media)) AS n_files FROM (SELECT count(*) AS bad FROM
          (SELECT e.*, f.n - coalesce(l.n, 0) AS final, coalesce(l.n, 0) AS removed FROM expect e JOIN final_n f USING ("table") LEFT JOIN lost l USING ("table"))
        WHERE final > sum_source OR (final < max_carried - removed AND "table" <> 'BlockRange'))""",
    "roundtrip": "SELECT \"table\", n AS expected, n AS final, true AS same, true AS contents, CAST(0 AS BIGINT) AS dangling FROM final_n",
    "roundtrip_changed": """SELECT "table", n AS expected, CASE WHEN lost THEN 0 ELSE n END AS final, NOT lost AS same, NOT lost AND "table" <> 'Note' AS contents,
        CASE WHEN "table" = 'PlaylistItem' THEN n ELSE 0 END AS dangling FROM (SELECT *, "table" = 'PlaylistItemAccuracy' AS lost FROM final_n)""",
    "idempotent_remerge": "SELECT \"table\", n, true AS same FROM final_n",
    "late_notes": _LATE_NOTES,
    "late_counts": "SELECT \"table\", n FROM final_n WHERE \"table\" IN ('Location', 'UserMark', 'Note', 'Tag', 'IndependentMedia', 'InputField', 'Bookmark')",
    "health_damaged": " UNION ALL ".join(_health_sql(c[0], False, "d_") for c in CHECKS),
    "health_members": f"""WITH styled AS (SELECT u.*, rs, ColorIndex * 1000 + StyleIndex AS look FROM d_UserMark u JOIN {_RS.format(k='src, ', t='d_')} r ON r.src = u.src AND r.UserMarkId = u.UserMarkId),
        wide AS (SELECT *, min(look) OVER w <> max(look) OVER w AS unlike, count(*) OVER s > 1 AS equal, row_number() OVER (w ORDER BY UserMarkId) AS n5, row_number() OVER (s ORDER BY UserMarkId) AS n4,
          min(UserMarkId) OVER w AS lead5, min(UserMarkId) OVER s AS lead4 FROM styled WINDOW w AS (PARTITION BY src, LocationId, rs), s AS (PARTITION BY src, LocationId, rs, look))
        SELECT src, 'C4' AS code, lead4 AS first_id, n4 AS nth, UserMarkId FROM wide WHERE equal UNION ALL SELECT src, 'C5', lead5, n5, UserMarkId FROM wide WHERE unlike""",
    "row_rules_damaged": " UNION ALL ".join(
        f"SELECT src, '{t}' AS \"table\", '{rule}' AS rule, count(*) AS violations FROM d_{t} WHERE {broken} GROUP BY src" for t, rules in BROKEN_ROWS.items() for rule, broken in rules),
    "unique_damaged": " UNION ALL ".join(
        f"SELECT src, '{t}' AS \"table\", '{name}' AS \"constraint\", count(*) AS violations FROM (SELECT src FROM d_{t} WHERE {_set(key)} GROUP BY src, {key} HAVING count(*) > 1) GROUP BY src"
        for t, keys in SINGLE.items() for name, key in keys),
    "references_damaged": " UNION ALL ".join(
        f"SELECT c.src, '{t}' AS \"table\", '{column}' AS \"column\", count(*) AS violations {_absent('d_' + t, column, parent, 'd_')} GROUP BY c.src"
        for t, refs in REFERS.items() for column, parent in refs),
    "write_rejects": " UNION ALL ".join(f"SELECT src, '{t}' AS \"table\", rule, count(*) AS n FROM bad_{t} GROUP BY src, rule" for t in SINGLE),
    "write_split": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM ok_{t}) AS final, true AS same, true AS contents, CAST(0 AS BIGINT) AS dangling" for t in SINGLE),
    "cleanup_damaged": """SELECT src, action, count(*) AS n FROM (
        SELECT src, 'emptyNotes' AS action FROM dc_gone_notes UNION ALL SELECT src, 'rangelessHighlights' FROM dc_gone_marks
        UNION ALL SELECT n.src, 'notesDetached' FROM dc_notes n JOIN dc_gone_marks g ON g.src = n.src AND g.UserMarkId = n.UserMarkId
        UNION ALL SELECT src, 'duplicateHighlights' FROM dc_marks WHERE nth > 1
        UNION ALL SELECT n.src, 'notesReattached' FROM dc_notes n JOIN dc_marks m ON m.src = n.src AND m.UserMarkId = n.UserMarkId WHERE nth > 1
        UNION ALL SELECT src, 'unusedMedia' FROM dc_gone_media
        UNION ALL SELECT src, 'emptyPlaylists' FROM d_Tag g WHERE Type = 2 AND NOT EXISTS (SELECT 1 FROM d_TagMap t WHERE t.src = g.src AND t.TagId = g.TagId)
        UNION ALL SELECT src, 'unreferencedLocations' FROM d_Location l WHERE NOT EXISTS (SELECT 1 FROM dc_uses u WHERE u.src = l.src AND u.LocationId = l.LocationId)) GROUP BY src, action""",
    "traceability": """SELECT s."table", CAST(0 AS BIGINT) AS untraced, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS leaked, CAST(coalesce(sum(dropped), 0) AS BIGINT) AS dropped
        FROM source_n s LEFT JOIN dropped d ON d.src = s.src AND d."table" = s."table" GROUP BY s."table\"""",
    "content_digest": _digest("Location"),
    "fingerprint": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", * FROM ({_digest(t)})" for t in schema.TABLES),
    "validation_report": f"""SELECT bad + fk = 0 AS ok, fk AS foreign_key_violations, bad + CAST(fk > 0 AS INT) AS n_errors FROM
        (SELECT count(*) AS bad FROM expect e JOIN final_n f USING ("table") WHERE f.n > sum_source OR (f.n < max_carried AND "table" <> 'BlockRange')),
        (SELECT CAST(sum(violations) AS BIGINT) AS fk FROM ({_FK_MERGED}))""",
    "output_manifest": """SELECT 'UserdataBackup_2026-09-06_Merged.zip' AS name, 1 AS version, 0 AS type, '2026-09-06T15:00:00+00:00' AS "lastModifiedDate",
        'Merged (' || count(*) || ' backups)' AS "deviceName", 'userData.db' AS "databaseName", 16 AS "schemaVersion" FROM s_sources""",
    "compatibility": """SELECT true AS ok, 0 AS n_errors, 'migration levels differ: ' || string_agg(label || ' = ' || MigrationId, ', ' ORDER BY i.src) AS warnings, 16 AS schema_version,
        1 AS template_src, 'v16' AS migration_id, 16 AS user_version, arg_max(i.LastModified, epoch_ms(CAST(i.LastModified AS TIMESTAMPTZ))) AS latest_last_modified, count(*) AS n_sources
        FROM info i JOIN s_sources s ON s.src = i.src""",
    "source_labels": """SELECT src, base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY src) AS n FROM (
        SELECT CAST(n_nationkey AS INT) AS src, CASE WHEN n_nationkey % 4 <> 0 THEN r_name WHEN n_nationkey % 8 <> 0 THEN n_name ELSE 'Backup ' || (n_nationkey + 1) END AS base
        FROM nation JOIN region ON n_regionkey = r_regionkey))""",
    "template": "SELECT n_regionkey, arg_max(n_nationkey, (n_nationkey % 7) * 1000 - n_nationkey) AS template_src FROM nation GROUP BY n_regionkey",
    "source_summary": """SELECT i.src, label, i.LastModified, (SELECT CAST(sum(n) AS BIGINT) FROM source_n c WHERE c.src = i.src) AS n_rows,
        (SELECT count(*) FROM source_n c WHERE c.src = i.src) AS n_tables, (SELECT count(*) FROM s_Tag t WHERE t.src = i.src AND Type = 2) AS n_playlists,
        (SELECT count(*) FROM s_media_files t WHERE t.src = i.src) AS n_files FROM info i""",
    "headline_counts": "SELECT count(*) FILTER (Type = 2) AS playlists, count(*) FILTER (Type <> 2) AS tags FROM m_Tag",
    "admit_files": """WITH o AS (SELECT page_id, 'f' || (page_id % 7) || CASE WHEN page_id % 11 = 0 THEN '.txt' WHEN page_id % 2 = 0 THEN '.ZIP' ELSE '.zip' END AS name,
          CAST(CASE WHEN page_id % 13 = 0 THEN 0 WHEN page_id % 17 = 0 THEN 3221225472 ELSE length(html) % 40 END AS BIGINT) AS size FROM pages),
        j AS (SELECT *, CASE WHEN page_id % 11 = 0 THEN 'wrong suffix' WHEN size = 0 THEN 'empty' WHEN size > 2147483648 THEN 'too large' END AS r FROM o)
        SELECT page_id, name, size, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY name, size, r IS NULL ORDER BY page_id) > 1 THEN 'already offered' END) AS rejection FROM j""",
    "manifest_scan": f"""SELECT event_id, e AS error, CASE WHEN e IS NULL THEN event_type END AS name, CASE WHEN e IS NULL THEN 'd' || user_id END AS "deviceName",
        CASE WHEN e IS NULL THEN 'userData.db' END AS "databaseName", CASE WHEN e IS NULL THEN 1 END AS version, CASE WHEN e IS NULL THEN 0 END AS type,
        CASE WHEN e IS NULL THEN {_MANIFEST_VERSION} END AS "schemaVersion" FROM (SELECT *, {_MANIFEST_BAD} AS e FROM events)""",
    "media_inventory": "SELECT src, path, octet_length(encode(content)) AS size, sha256(content) AS sha256 FROM s_media_files",
    "ts_order": f"""SELECT event_id, {_TS_NORMAL} AS normal, {_TS_MS} AS ms, event_id % 6 <> 5 AS ok, CASE WHEN event_id % 6 = 5 THEN 'about ' || base ELSE '' END AS txt,
        strftime(make_timestamp(({_TS_MS}) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS utc, regexp_replace({_TS_RAW}, 'Z$', '+00:00') AS offset_form
        FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS base, epoch_ms(date_trunc('second', ts)) AS ms FROM events)""",
    "normalize_text": f"""SELECT doc_id, {norm("('  ' || chr(9) || replace(text, ' ', ' ' || chr(9)) || chr(13) || chr(10) || chr(65279))")} AS normal,
        {trim("coalesce(text, '')")} = '' AS blank FROM documents""",
    "describe_location": f"SELECT src, LocationId, {describe()} AS text FROM s_Location",
    "location_keys": f"""SELECT src, LocationId, rank, key FROM (
        SELECT src, LocationId, 1 AS rank, CASE WHEN BookNumber IS NOT NULL AND ChapterNumber IS NOT NULL AND KeySymbol IS NOT NULL AND MepsLanguage IS NOT NULL
          THEN concat_ws('|', 'T', BookNumber, ChapterNumber, KeySymbol, MepsLanguage, Type) END AS key FROM s_Location UNION ALL
        SELECT src, LocationId, 2, CASE WHEN KeySymbol IS NOT NULL AND MepsLanguage IS NOT NULL AND DocumentId IS NOT NULL AND Track IS NOT NULL
          THEN concat_ws('|', 'M', KeySymbol, IssueTagNumber, MepsLanguage, DocumentId, Track, Type, '', '') END FROM s_Location UNION ALL
        SELECT src, LocationId, 3, concat_ws('|', 'F', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _LOC[:8])}, '', '') FROM s_Location) WHERE key IS NOT NULL""",
    "fnv_guid": f"""SELECT p_partkey, {fnv('seed', GUID_SEEDS[0])} AS fnv, {guid('seed')} AS guid FROM (SELECT p_partkey, p_name || '|' || p_brand || '|' || p_partkey AS seed FROM part)""",
    "device_kind": """SELECT event_id, CASE WHEN regexp_matches(n, 'ipad|tablet|\\btab\\b') THEN 'tablet' WHEN regexp_matches(n, 'iphone|pixel|galaxy|android|phone|mobile') THEN 'phone'
        WHEN regexp_matches(n, 'desktop|laptop|macbook|imac|\\bmac\\b|windows|\\bpc\\b|book|surface') THEN 'desktop' ELSE 'unknown' END AS kind
        FROM (SELECT event_id, lower(['My iPad', 'iPhone 15', 'tab s9', 'Windows PC', 'iMac', 'stable', 'Pixel tablet', 'x', 'MacBook', 'phone'][user_id % 10 + 1] || ' of ' || event_type) AS n FROM events)""",
    "format_bytes": f"""SELECT o_orderkey, size, format('{{:,}}', size) || CASE WHEN size = 1 THEN ' byte' ELSE ' bytes' END AS plural,
        CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_short('size / 1024.0')} || ' KB'
          WHEN size < 1073741824 THEN {_short('size / 1048576.0')} || ' MB'
          ELSE {_short('size / 1073741824.0')} || ' GB' END AS text FROM (SELECT o_orderkey, {_SIZE} AS size FROM orders)""",
    "color_dim": f"""SELECT coalesce(c.name, 'Colour ' || {_MARKS}) AS name, coalesce(c.hex, '#9aa3b8') AS hex, count(*) AS n FROM s_UserMark
        LEFT JOIN (VALUES {', '.join(f"({i}, '{n}', '{h}')" for i, n, h in HIGHLIGHT_COLORS)}) c(i, name, hex) ON c.i = {_MARKS} GROUP BY ALL""",
    "split_ext": f"SELECT page_id, substr(url, 1, length(url) - length({ext('url')})) AS base, {ext('url')} AS ext, lower(url) AS path_key FROM pages",
}


def _compose(sql: str) -> str:
    """Statement with the common table expressions it needs, in dependency order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
            if name in CTES and name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    # A statement with its own WITH goes into a subquery behind the shared expressions.
    # Expressions used more than once are computed once.
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return f"WITH {head}\nSELECT * FROM ({sql})"


ORACLES = {name: _compose(sql) for name, sql in _FINAL.items()}
