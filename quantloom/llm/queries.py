"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import apportion, block_ann, bpe_table, chat_format, line_dedup, lm_trie, ordinal, quality_rules, ranked_search, simhash, tag_paths, turn_repair, warc_norm
from quantloom.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.score_documents(read(spark, sf_dir, "documents"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_probe(read(spark, sf_dir, "conversations"))
    back = chat_format.read_back(chat_format.chunks(turns))
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_table.digest(bpe_table.encode(docs, path, with_decoded=True))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.train(docs, ordinal.graded(read(spark, sf_dir, "labels"))))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_norm.archive_round_trip(read(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apportion.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return block_ann.search(rows.where(F.col("vec_id") % 20 == 0), rows)


def op11_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.damage(turns), turns)


def op12_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


def op13_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_trie, op2_line_rules, op3_chat_prefix, op4_bpe_table, op5_ordinal,
        op6_warc_normaliser, op7_line_dedup, op8_simhash_anchor, op9_sainte_lague, op10_block_ann,
        op11_lr_repair, op12_best_position, op13_tag_paths,
    )
}

_STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPACES, _ESC = r"[\x20\x09-\x0D]+", "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PHRASES = " or ".join(f"contains(low, '{p}')" for p in quality_rules.BOILERPLATE)
_MARKS = quality_rules.END_MARKS.replace("'", "''")
_SEP = quality_rules.SEPARATORS
_BARE = f"length(regexp_replace({{0}}, '{_SPACES}', '', 'g'))"
_SYM = "length({0}) - length(regexp_replace({0}, '[#*$%&|<>]', '', 'g'))"
ORACLE = {
    "op2_line_rules": f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, list_filter(string_split_regex(t, '{_SPACES}'), lambda x: x <> '') as ws, string_split(t, chr(10)) as ls from d),
        x as (select doc_id, unnest(range(1, len(ws) - 1)) as p, ws from w where len(ws) >= 3),
        k as (select doc_id, p, count(*) over (partition by doc_id, ws[p], ws[p + 1], ws[p + 2]) as c from x),
        r as (select doc_id, count(distinct p + j) as n from k cross join (values (0), (1), (2)) v(j) where c > 1 group by doc_id),
        l as (select doc_id, unnest(ls) as line from w),
        f as (select doc_id, line, lower(line) as low, {_BARE.format('line')} as bare, {_SYM.format('line')} as sym, right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as tip from l),
        g as (select doc_id, line, bare, bare > 0 and (not regexp_matches(line, '[\\p{{L}}\\p{{N}}]') or sym > bare * 0.1
              or (length(line) - length(regexp_replace(line, '[{_SEP}]', '', 'g')) >= 3 and not regexp_matches(line, '[^{_SEP}]{{{{41}}}}'))
              or (not contains('{_MARKS}', tip) and len(list_filter(string_split_regex(line, '{_SPACES}'), lambda x: x <> '')) >= 8)
              or regexp_matches(line, '(©|\\(c\\)|copyright)[\\x20\\x09]{{{{0,3}}}}(19|20)[0-9]{{{{2}}}}', 'i')
              or regexp_matches(line, '^[\\x20\\x09-\\x0D]*(https?://|www[.])[^\\x20\\x09-\\x0D]*[\\x20\\x09-\\x0D]*$') or {_PHRASES}) as fails from f),
        s as (select doc_id, coalesce(sum(case when fails then bare end), 0) as lost, count(case when bare > 0 then 1 end) - count(distinct case when bare > 0 then line end) as dup from g group by doc_id),
        a as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast({_BARE.format('t')} as bigint) as word_chars, cast({_SYM.format('t')} as bigint) as n_symbols,
              dup as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, lost from w join s on s.doc_id = w.doc_id left join r on r.doc_id = w.doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= word_chars * 0.3::double as kept from a""".replace("{{", "{").replace("}}", "}"),
    "op3_chat_prefix": f"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -7, 0, 'user', '{chat_format.INJECTION}' union all select -7, 1, 'assistant', '{chat_format.INJECTION}'),
        a as (select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
              coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
              sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 11) as size from c group by conv_id)
        select conv_id, n as n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(size as bigint) as formatted_chars from a""",
    "op6_warc_normaliser": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
        f as (select *, min(page_id) over (partition by h) as first from d)
        select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
               case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id <> first then first end as refers_to
        from f""",
    "op7_line_dedup": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
        k as (select *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        s as (select key, max(doc_id) as holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        j as (select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.holder as gone from k left join s on k.key = s.key)
        select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from j group by doc_id""",
    "op10_block_ann": """
        with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
        p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) as score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    # Cheapest edits from the last row back, for the four states of the role grammar: start, after s, after u, after a.
    "op11_lr_repair": r"""
        with recursive ct as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as t from range(256) r(n)),
        o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
              list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as b from conversations),
        c as (select o.*, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8))) % 20 as f from o, ct),
        d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
              unnest(case when f = 3 then [0, 1] else [0] end) as copy from c where f <> 0),
        n as (select *, row_number() over w as rn, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
              lag(role[1:1]) over w || role[1:1] as pair, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as cut from d window w as (partition by conv_id order by turn nulls first, role, text, copy)),
        r as (select *, case when cut = '' then 'b' when seen > 1 then 'd' when cut[-1:] not in ('.', '!', '?') then 't' else '' end as fault from n),
        s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n, count(*) filter (where fault = 'b') as blank,
              count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
        dp as (
          select conv_id, n as k, {'c': 0::bigint, 'a': '', 't': ''} as g0, {'c': 6::bigint, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} as g1,
                 {'c': 3::bigint, 'a': 'I', 't': 'assistant:'} as g2, {'c': 0::bigint, 'a': '', 't': ''} as g3 from s
          union all
          select conv_id, k, list_sort([e0, {'c': g2.c + 3, 'a': 'I' || g2.a, 't': 'user:' || case when g2.t = '' then '' else chr(10) || g2.t end}])[1],
                 list_sort([e1, {'c': g2.c + 3, 'a': 'I' || g2.a, 't': 'user:' || case when g2.t = '' then '' else chr(10) || g2.t end}])[1], g2,
                 list_sort([e3, {'c': e2.c + 3, 'a': 'I' || e2.a, 't': 'user:' || case when e2.t = '' then '' else chr(10) || e2.t end}])[1]
          from (select *, list_sort([e2, {'c': e3.c + 3, 'a': 'I' || e3.a, 't': 'assistant:' || case when e3.t = '' then '' else chr(10) || e3.t end}])[1] as g2 from (
            select conv_id, k, list_sort([del0, ru] || case when i = 's' and kept then [{'c': g1.c + p, 'a': 'K' || g1.a, 't': said || case when g1.t = '' then '' else chr(10) || g1.t end}] when i = 'u' and kept then [ku] else [] end)[1] as e0,
                   list_sort([del1, ru] || case when i = 'u' and kept then [ku] else [] end)[1] as e1,
                   list_sort([del2, ra] || case when i = 'a' and kept then [ka] else [] end)[1] as e2,
                   list_sort([del3, ru] || case when i = 'u' and kept then [ku] else [] end)[1] as e3
            from (select dp.conv_id, dp.k - 1 as k, r.role[1:1] as i, r.fault not in ('b', 'd') as kept, case when r.fault = 't' then 3 else 0 end as p, r.role || ':' || r.text as said, g1,
                   {'c': g0.c + 4, 'a': 'D' || g0.a, 't': g0.t} as del0, {'c': g1.c + 4, 'a': 'D' || g1.a, 't': g1.t} as del1,
                   {'c': g2.c + 4, 'a': 'D' || g2.a, 't': g2.t} as del2, {'c': g3.c + 4, 'a': 'D' || g3.a, 't': g3.t} as del3,
                   {'c': g2.c + p, 'a': 'K' || g2.a, 't': said || case when g2.t = '' then '' else chr(10) || g2.t end} as ku,
                   {'c': g3.c + p, 'a': 'K' || g3.a, 't': said || case when g3.t = '' then '' else chr(10) || g3.t end} as ka,
                   {'c': g2.c + p + case when kept then 3 else 1000000000 end, 'a': 'R' || g2.a, 't': 'user:' || r.text || case when g2.t = '' then '' else chr(10) || g2.t end} as ru,
                   {'c': g3.c + p + case when kept then 3 else 1000000000 end, 'a': 'R' || g3.a, 't': 'assistant:' || r.text || case when g3.t = '' then '' else chr(10) || g3.t end} as ra
                  from dp join r on r.conv_id is not distinct from dp.conv_id and r.rn = dp.k))))
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(g0.c, 0) as cost, coalesce(g0.a, '') as audit, sha256(coalesce(g0.t, '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join s on s.conv_id is not distinct from o.conv_id left join dp on dp.conv_id is not distinct from o.conv_id and dp.k = 0""",
    "op12_best_position": r"""
        with d as (select doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
        t as (select doc_id, unnest(ws) as term from d),
        f as (select doc_id, term, count(*) as tf from t where term <> '' group by all),
        s as (select doc_id, cast(sum(tf) as bigint) as n from f group by doc_id),
        a as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as length from s),
        i as (select item_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from f cross join a group by term, docs),
        p as (select item_id, f.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
              from (select distinct item_id, term from i where term <> '') j join f using (term) join w using (term) join s on s.doc_id = f.doc_id cross join a group by item_id, f.doc_id),
        r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50""",
}
