"""Declared schemas of the source tables, and column descriptions of the published tables."""

from __future__ import annotations

COMM_HISTORY = "message_time timestamp_ntz, dispatcher_id int, message_data string"
COMM_VEHICLE_SNAPSHOT = "snapshot_time timestamp_ntz, driver_id int"
OPERATOR = "operator_id int, onboard_logon_id int"
ADHERENCE_SOURCE = (
    "trip_id string, scheduled_date date, scheduled_time string, vehicle_id string, "
    "driver_payrollNumber string, lsStopSequence int, stop_id string, actual_time string, "
    "actual_date date, sched_adherence_secs double, stop_name string, early_flag int, IsNode int"
)
WRITEUPS = "driverID string, incidentDate timestamp_ntz, evidenceOfViolation string"

# Descriptions by published column name.
TEXT_DATA = {
    "TripId": "Trip the stop belongs to",
    "WorkPieceId": "Salted id of the work piece: one continuous run of stops of a trip and operator",
    "MiddleStop": "Ordinal of the middle stop of a comparison work piece; empty when treated",
    "RelativeStopSequence": "Stops after the message stop (treated) or the middle stop (comparison)",
    "TotalMessages": "Matched messages of this operator in the study period",
    "DepartureDateTime": "When the bus departed from the stop",
    "MessageId": "Id of the message received at this stop; empty if none",
    "MessageDateTime": "When that message was sent; empty if none",
    "ScheduledDate": "Service date of the scheduled departure",
    "ScheduledTime": "Scheduled time of day of the departure",
    "VehicleId": "Vehicle that ran the trip",
    "StopSequence": "Ordinal of the stop in its work piece, 1 to n",
    "StopId": "Stop",
    "DepartureTime": "Actual time of day of the departure",
    "AdherenceSecs": "Actual minus scheduled departure in seconds; negative is early",
    "StopName": "Name of the stop",
    "Early": "1 if the agency counts the departure as early, else 0",
    "TimePointFlag": "Whether the stop is a time point",
    "ScheduledDateTime": "Scheduled departure as date and time",
    "TreatmentGroup": "Comparison Group or Treatment Group",
    "TreatmentPeriod": "Pre-text or Post-text",
    "OperatorIdHash": "Salted hash of the operator id",
}
ORDINALS = ("first", "second", "third", "fourth")


def discipline_data(n: int = 4) -> dict[str, str]:
    """Descriptions of the discipline panel with ``n`` dates."""
    name = lambda i: ORDINALS[i - 1] if i <= len(ORDINALS) else f"{i}th"
    dates = {f"discipline_date_{i}": f"Date of the {name(i)} discipline" + ("; empty if none" if i > 1 else "")
             for i in range(1, n + 1)}
    relative = {f"date_relative_{i}": f"Days since the {name(i)} discipline"
                + ("; negative before it" if i == 1 else "") for i in range(1, n + 1)}
    return {
        "date": "Day of the daily averages",
        "early_rate": "Share of time-point departures that were early that day",
        "mean_secs": "Mean adherence in seconds at time points that day",
        "discipline": "Whether the operator was disciplined that day",
        **dates,
        "total_disciplines": "Disciplines of this operator in the study period",
        **relative,
        "period": "Pre-discipline or Post-discipline, by the first one",
        "discipline_ind": "Whether the operator was disciplined that day",
        "operator_id_hash": "Salted hash of the operator id",
    }


DISCIPLINE_DATA = discipline_data()
