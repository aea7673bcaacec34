"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_HITS = (
    "b as (select query_id, doc_id, max(score) score from search_results where score is not null and not isnan(score) and query_id is not null and doc_id is not null group by 1,2), "
    "k as (select doc_id, max((computed_at, case when isnan(score) then null else score end)) m from pagerank_scores group by 1), "
    "h as (select query_id, b.doc_id, score, coalesce(m[2],0.0) link from b left join k using(doc_id)), "
    "p as (select *, count(*) over (partition by query_id) n, row_number() over (partition by query_id order by score desc, doc_id) ps, "
    "row_number() over (partition by query_id order by link desc, doc_id) pl from h)"
)
_PART = (
    "u as (select *, 0.5-(ps-0.5)/n x, 0.5-(pl-0.5)/n y from p), "
    "c as (select coalesce(sum(x*y)/sqrt(sum(x*x)*sum(y*y)),0) r, sqrt(0.5) a from u)"
)
_CELLS = (
    "ids as (select distinct word_id, lower(regexp_replace(word,'^\\s+|\\s+$','','g')) word from lexicon where word_id is not null and regexp_replace(word,'^\\s+|\\s+$','','g')<>''), "
    "r as (select distinct f.doc_id, ids.word, f.word_id, f.freq from forward_index f join ids using(word_id) where f.freq>0 and f.doc_id is not null), "
    "cell as (select doc_id, word, cast(sum(freq) as bigint) freq from r group by 1,2)"
)
_MARK = (
    "nd as (select count(distinct doc_id) n from cell), t as (select word, cast(sum(freq) as bigint) total, count(*) docs from cell group by 1), "
    "m as (select w.word, coalesce(total,0) total, coalesce(docs,0) docs, case when coalesce(docs,0)=0 then null when docs<=2 then 'rare' when docs>0.1*n then 'common' end mark "
    "from (select distinct word from ids) w left join t using(word), nd)"
)
_RES = (
    "ti as (select distinct doc_id, lower(unnest(regexp_extract_all(coalesce(title,''),'[A-Za-z0-9]+'))) word from doc_metadata where doc_id is not null), "
    "tb as (select doc_id, word, cast(coalesce(freq,0) as bigint) freq, greatest(coalesce(freq,0),1) o, ti.word is not null titled from cell full join ti using(doc_id, word)), "
    "g as (select sum(o) n from tb), rr as (select doc_id, sum(o) r from tb group by 1), cc as (select word, sum(o) c, count(*) filter (freq>0) docs from tb group by 1), "
    "sc as (select doc_id, word, freq, docs, titled, r*c/n e, o, r*c/n*(1-r/n)*(1-c/n) v from tb join rr using(doc_id) join cc using(word), g)"
)


def llm_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "p1_found": f"with {_HITS} select query_id, doc_id from p where n>=10 and ps<=5 and pl<=5",
        # a 2x2 correlation matrix has the eigenvectors (1,1) and (1,-1) with 1+r and 1-r; only the first has one sign
        "p1_rank": (
            f"with {_HITS}, {_PART} select query_id, doc_id, row_number() over (partition by query_id "
            "order by round(a*x+a*y,9) desc, doc_id) place, ps pos_score, pl pos_link from u, c"
        ),
        "p1_component": (
            f"with {_HITS}, {_PART} select s score, round(a,6) loading, round(1+r,6) eigenvalue, cast(case when r>=0 then 1 else 2 end as bigint) place "
            "from c, (values ('score'),('link')) v(s)"
        ),
        "p4_found": f"with {_CELLS}, {_MARK} select word, mark from m where mark is not null",
        "p4_counts": f"with {_CELLS}, {_MARK} select word, total, docs, mark from m",
        "p5_found": (
            f"with {_CELLS}, df as (select word, count(*) d from cell group by 1), x as (select doc_id, word, freq, d, count(*) over w n, max(freq) over w mf, min(d) over w md from cell join df using(word) "
            "window w as (partition by doc_id)), y as (select *, count(*) filter (freq=mf) over w nf, count(*) filter (d=md) over w nm from x window w as (partition by doc_id)) "
            "select doc_id, word from y where n>=2 and freq=mf and d=md and nf=1 and nm=1 and exists (select 1 from doc_metadata t where t.doc_id=y.doc_id "
            "and list_contains(list_transform(regexp_extract_all(coalesce(t.title,''),'[A-Za-z0-9]+'), lambda a: lower(a)), y.word))"
        ),
        "p5_scores": f"with {_CELLS}, {_RES} select doc_id, word, freq, round(case when v>0 then (o-e)/sqrt(v) else 0 end, 6) residual from sc",
    }
