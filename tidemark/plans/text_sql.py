"""SQL spellings of the text rules, for the checks."""

from __future__ import annotations

from tidemark.functions import text as tx


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def fold(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


def normalize(x: str) -> str:
    return f"array_to_string(regexp_extract_all({fold(x)}, '[a-z0-9]+'), ' ')"


def lemma(x: str) -> str:
    parts = [f"WHEN {x} = '{a}' THEN '{b}'" for a, b in tx.IRREGULAR.items()]
    parts += [f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 3} THEN left({x}, length({x}) - {len(s)})" for s in tx.SUFFIXES]
    parts += [f"WHEN ends_with({x}, 'es') AND length({x}) > 5 THEN left({x}, length({x}) - 2)", f"WHEN ends_with({x}, 's') AND length({x}) > 4 THEN left({x}, length({x}) - 1)"]
    return f"CASE {' '.join(parts)} ELSE {x} END"


def content(x: str) -> str:
    return f"(length({x}) >= 4 AND {x} NOT IN ({quoted(tx.STOP_FOLDED)}) AND {x} NOT IN ({quoted(tx.GENERIC_FOLDED)}))"


def terms(source: str, keys: str, text: str = "text") -> dict[str, str]:
    return {
        "tk": f"SELECT {keys}, unnest(t) AS tok, unnest(range(len(t))) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '{tx.LATIN}') AS t FROM {source})",
        "tf": f"SELECT {keys}, i, lower(tok) AS a, {fold('tok')} AS f FROM tk",
        "tc": f"SELECT *, {content('f')} AS ok FROM tf",
        "tw": f"SELECT {keys}, a, f, ok, lead(a) OVER w AS b, lead(ok) OVER w AS ok_b, lead(a, 2) OVER w AS c, lead(ok, 2) OVER w AS ok_c FROM tc WINDOW w AS (PARTITION BY {keys} ORDER BY i)",
        "tt": f"""SELECT {keys}, {lemma('f')} AS term FROM tw WHERE ok
            UNION ALL SELECT {keys}, a || ' ' || b FROM tw WHERE ok AND ok_b AND a || ' ' || b NOT IN ({quoted(tx.FILLER_PHRASES)})
            UNION ALL SELECT {keys}, a || ' ' || b || ' ' || c FROM tw WHERE ok AND ok_c AND a || ' ' || b || ' ' || c NOT IN ({quoted(tx.FILLER_PHRASES)})""",
        "counts": f"SELECT {keys}, term, count(*) AS frequency FROM tt GROUP BY ALL",
    }


def distinctive(source: str, keys: str, corpus: str | None, maximum: int, text: str = "text") -> dict[str, str]:
    if corpus:
        freq = f"""SELECT c.*, d.document_frequency, n.documents FROM counts c JOIN (SELECT {corpus}, term, count(*) AS document_frequency FROM counts GROUP BY ALL) d USING ({corpus}, term)
            JOIN (SELECT {corpus}, count(*) AS documents FROM {source} GROUP BY 1) n USING ({corpus})"""
    else:
        freq = "SELECT *, 1 AS document_frequency, 1 AS documents FROM counts"
    q = lambda i: f"substr(n, 1 + length(n) * {i} // 4, length(n) * {i + 1} // 4 - length(n) * {i} // 4)"
    hits = " + ".join(f"CAST(contains(q{i}, nt) AS INTEGER)" for i in range(4))
    return {
        **terms(source, keys, text),
        "fr": freq,
        "qs": f"SELECT {keys}, {', '.join(f'{q(i)} AS q{i}' for i in range(4))} FROM (SELECT {keys}, {normalize(text)} AS n FROM {source})",
        "sp": f"SELECT fr.*, ({hits}) / 4 AS distribution FROM (SELECT *, {normalize('term')} AS nt FROM fr) fr JOIN qs USING ({keys})",
        "sr": f"""SELECT *, ln(1 + frequency) * (ln((1 + documents) / (1 + document_frequency)) + 1) * (0.65::DOUBLE + 0.35::DOUBLE * distribution)
            * CASE WHEN contains(term, ' ') THEN 1.35::DOUBLE ELSE 1 END * CASE WHEN term IN ({quoted(tx.GENERIC_TERMS)}) THEN 0.35::DOUBLE ELSE 1 END AS score FROM sp""",
        "so": f"SELECT {keys}, list({{'term': term, 'score': score, 'frequency': frequency, 'document_frequency': document_frequency, 'distribution': distribution}} ORDER BY round(score, 9) DESC, frequency DESC, term) AS l FROM sr GROUP BY {keys}",
        "chosen": f"""SELECT {keys}, list_reduce(l, lambda acc, x: CASE WHEN len(acc) >= {maximum} OR len(list_filter(acc, lambda y: contains(y.term, x.term) OR contains(x.term, y.term))) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0]) AS terms FROM so""",
    }
