"""The numbered queries and their SQL."""

from . import centroids, decontam, divergence, html_extract, langid, license_scan, media, pieces, pii, ppm, simhash, toxicity, url_filter


def queries():
    return {
        "op1_ppm_score": ppm.op1,
        "op2_simhash": simhash.op2,
        "op3_pii": pii.op3,
        "op4_toxicity": toxicity.op4,
        "op5_language_id": langid.op5,
        "op6_sentencepiece": pieces.op6,
        "op7_media": media.op7,
        "op8_decontamination": decontam.op8,
        "op9_html": html_extract.op9,
        "op10_url_filters": url_filter.op10,
        "op11_centroids": centroids.op11,
        "op12_licenses": license_scan.op12,
        "op13_divergence": divergence.op13,
    }


def oracle_sql():
    return {
        "op8_decontamination": decontam.OP8_SQL,
        "op10_url_filters": url_filter.OP10_SQL,
        "op11_centroids": centroids.OP11_SQL,
        "op12_licenses": license_scan.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
