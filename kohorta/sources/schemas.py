"""Table schemas."""

POST = (
    "id bigint, created_at string, text string, full_text string, "
    "extended_tweet struct<full_text: string>, lang string, user struct<id: bigint>"
)
LABELLED = "text string, labels int"
PERIODS = "user_id bigint, quarter int, d_t0 date, date_tn date, exposition int, outcome int"
INTERVALS = "user_id bigint, quarter int, start bigint, stop bigint, exposition int, outcome int"
