"""Land-parcel planning analytics and training-data operators on Spark."""
