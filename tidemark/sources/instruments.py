"""The instrument dimension: class and sector of each ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The universe by asset class.
UNIVERSE = {
    "FX": "EURUSD=X GBPUSD=X USDJPY=X AUDUSD=X USDCAD=X USDCHF=X NZDUSD=X USDCNH=X USDSEK=X USDNOK=X USDBRL=X USDMXN=X USDZAR=X USDINR=X USDKRW=X EURGBP=X EURJPY=X GBPJPY=X AUDJPY=X EURCAD=X",
    "ETF": "SPY QQQ IWM DIA VTI EFA EEM VWO XLF XLE XLK XLV XLI XLU XLRE XLB XLC XLP TLT IEF SHY HYG LQD TIP GLD SLV USO UNG PDBC",
    "EQ": "AAPL MSFT NVDA GOOGL AMZN META TSLA AVGO AMD INTC JPM BAC GS MS WFC C BLK AXP JNJ UNH LLY PFE ABBV MRK CVS XOM CVX COP SLB OXY WMT COST HD MCD NKE KO PEP PG BA CAT GE HON UPS LMT NEE T VZ",
    "FUT_COM": "GC=F SI=F HG=F PL=F PA=F CL=F BZ=F NG=F HO=F RB=F ZC=F ZW=F ZS=F ZL=F ZM=F KC=F CT=F SB=F CC=F LE=F",
    "FUT_IDX": "ES=F NQ=F RTY=F YM=F VX=F",
}
#: The sector of each ticker.
SECTORS = {
    "FX_Major": "EURUSD=X GBPUSD=X USDJPY=X AUDUSD=X USDCAD=X USDCHF=X NZDUSD=X",
    "FX_EM": "USDCNH=X USDBRL=X USDMXN=X USDZAR=X USDINR=X USDKRW=X",
    "FX_Minor": "USDSEK=X USDNOK=X",
    "FX_Cross": "EURGBP=X EURJPY=X GBPJPY=X AUDJPY=X EURCAD=X",
    "Broad_Eq": "SPY QQQ IWM DIA VTI",
    "Intl": "EFA EEM VWO",
    "Sector_ETF": "XLF XLE XLK XLV XLI XLU XLRE XLB XLC XLP",
    "FixedInc": "TLT IEF SHY HYG LQD TIP",
    "Cmdty_ETF": "GLD SLV USO UNG PDBC",
    "Tech": "AAPL MSFT NVDA GOOGL AMZN META TSLA AVGO AMD INTC",
    "Fin": "JPM BAC GS MS WFC C BLK AXP",
    "Health": "JNJ UNH LLY PFE ABBV MRK CVS",
    "Energy_EQ": "XOM CVX COP SLB OXY",
    "Consumer": "WMT COST HD MCD NKE KO PEP PG",
    "Indust": "BA CAT GE HON UPS LMT NEE T VZ",
    "Metals": "GC=F SI=F HG=F PL=F PA=F",
    "Energy_F": "CL=F BZ=F NG=F HO=F RB=F",
    "Grains": "ZC=F ZW=F ZS=F ZL=F ZM=F",
    "Softs": "KC=F CT=F SB=F CC=F LE=F",
    "Idx_Fut": "ES=F NQ=F RTY=F YM=F",
    "Vol_Fut": "VX=F",
}
#: Left out of evaluations.
EXCLUDED = ("VX=F",)


def instruments(spark: SparkSession) -> DataFrame:
    """ticker, asset_class and sector of the whole universe."""
    sector = {t: s for s, names in SECTORS.items() for t in names.split()}
    rows = [(t, c, sector.get(t, "unknown")) for c, names in UNIVERSE.items() for t in names.split()]
    return spark.createDataFrame(rows, "ticker string, asset_class string, sector string")


def with_instrument(df: DataFrame, dimension: DataFrame, entity: str = "ticker") -> DataFrame:
    """``df`` with the dimension's columns; 'unknown' where it lacks the entity. The dimension is small by nature;
    the engine broadcasts it where its size allows."""
    named = dimension.withColumnRenamed("ticker", entity)
    others = [c for c in named.columns if c != entity]
    return df.join(named, entity, "left").withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in others})
