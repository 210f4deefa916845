"""Builders of review rows and raw payloads, and rows that each show one rule.

Values are derived from the rules under test: the reference day is 2026-07-07, low signal
starts below 15 characters or 3 words, script consistency asks for 70 % Latin letters.
"""

import json

from larkspur.schema import REVIEW_COLUMNS


def review(review_id, **more):
    """A row with only what a row needs to be one; everything else is absent."""
    known = {"source": "apple_app_store", "app_name": "Harbour", "item_id": "31", "country": "nz", "language": "en", "rating": "2", "review_date": "2026-06-27T06:00:00Z", "collected_at": "2026-06-29T18:00:00Z"}
    return dict.fromkeys(REVIEW_COLUMNS, None) | known | {"review_id": review_id} | more


#: One body in two spellings, under two titles.
TWINS = ("\tThe  PASSWORD mail\nnever came ", "the password mail never came")
REVIEWS = [
    review("twin", review_title="Locked", review_text=TWINS[0]),
    review("other twin", review_title="Still locked", review_text=TWINS[1], developer_response="We are on it", app_version="4.2"),
    review("impossible day", review_title="Meh", review_text="The map view has a lag of seconds", rating="3.0", review_date="2026-02-30T10:00:00Z"),
    review("three topics", review_title="Renewal", review_text="They charged me twice and no representative answers", rating="5", review_date="2026-07-07T03:00:00+12:00", country="NZ "),
    review("nothing", review_title="\u2003", review_text="", rating=None, review_date=None, language=None),
    review("greek", review_title="Ωραία", review_text="πολύ καλή εφαρμογή για το λιμάνι", rating="4", review_date="2026-07-09T12:00:00Z", collected_at="2026-07-09T13:30:00Z", language="en-NZ"),
    review("wide", review_title="Maße", review_text="Ｔｉｄｅｓ  ① isn’t flagged, billingsgate is", rating="3.5", review_date="2026-06-27"),
]


def steam_page(records, cursor="c2"):
    """A page of (id, text, recommended, helpful votes)."""
    rows = [{"recommendationid": i, "review": text, "voted_up": up, "votes_up": votes, "author": {"steamid": f"s{i}", "playtime_forever": 90, "playtime_at_review": 45}, "timestamp_created": 1751328000} for i, text, up, votes in records]
    return json.dumps({"cursor": cursor, "reviews": rows})


def labelled(**fields):
    return {name: {"label": value} for name, value in fields.items()}


def apple_entry(entry_id, rating=None, votes=None, **fields):
    """An entry of the feed; without a rating it describes the app."""
    out = labelled(id=entry_id, **fields)
    out |= {} if rating is None else {"im:rating": {"label": rating}}
    return out | ({} if votes is None else {"im:voteSum": {"label": votes}})


def apple_page(*entries):
    """A feed page; a single entry stands without a list."""
    return json.dumps({"feed": {"entry": entries[0] if len(entries) == 1 else list(entries)}})


def google_batch(*records):
    """A batch of (id, text, score, reply)."""
    return json.dumps([{"reviewId": i, "content": text, "score": score, "thumbsUpCount": 7 * score, "replyContent": reply, "repliedAt": "", "reviewCreatedVersion": f"{score}.1"} for i, text, score, reply in records])


def saved_page(review_id, title, body, stars, votes, item="B0HARBOUR1"):
    """A saved response with one review, markup in its texts and a link to its item."""
    return (
        f"<section><p><a href='/product-reviews/{item}/all'>all</a></p><ul><li data-hook=review id=customer_review-{review_id}><h5 data-hook='review-title'>{title}</h5>"
        f"<i data-hook=review-star-rating>{stars} out of 5 stars</i><em class='a-profile-name'>Ada</em><b data-hook='avp-badge'>Verified</b>"
        f"<span data-hook='review-body'>{body}</span><small data-hook='helpful-vote-statement'>{votes}</small></li></ul></section>"
    )


HTML = saved_page("K7", "Sturdy <i>little</i> lamp", "Bright<br>&amp; <u>quiet</u>", "3.5", "2,048 people found this helpful")
