"""Analytics over irregularly sampled time series and source catalogues, written for Spark."""
